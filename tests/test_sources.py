import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, sinks

D = dt.date


def test_watchlist(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" aapl\n\n# note\nBRK-B\naapl\n  # other\n")
    assert sorted(r.ticker for r in files.read_watchlist(spark, str(tmp_path / "w.txt")).collect()) == ["AAPL", "BRK-B"]


def test_constituents(spark, tmp_path):
    df = spark.createDataFrame([("brk.b ", "Financials"), ("X", None)], ["Symbol", "GICS Sector"])
    assert sorted(map(tuple, files.constituents(df).collect())) == [("BRK-B", "Financials"), ("X", "Unknown")]
    (tmp_path / "c.json").write_text(json.dumps([["BF.B", "Staples"], ["A", "Health"]]))
    got = files.constituent_pairs(spark, str(tmp_path / "c.json"))
    assert sorted(map(tuple, got.collect())) == [("A", "Health"), ("BF-B", "Staples")]


def test_records_last_duplicate_wins(spark, tmp_path):
    recs = [{"date": "2023-12-31", "revenue": 1, "incomeTaxExpense": 2, "incomeBeforeTax": 10},
            {"date": "2023-12-31 00:00", "revenue": 3, "incomeTaxExpense": 9, "incomeBeforeTax": 10},
            {"date": "2023-09-30", "revenue": None, "incomeTaxExpense": 1, "incomeBeforeTax": 0}]
    (tmp_path / "r.json").write_text(json.dumps({"ticker": "k", "records": recs}))
    got = {(str(r.period_end), r.item): r.value for r in files.read_records(spark, str(tmp_path / "r.json"), "income", "quarterly").collect()}
    assert got["2023-12-31", "Total Revenue"] == 3 and got["2023-12-31", "Tax Rate For Calcs"] == 0.6
    assert got["2023-09-30", "Total Revenue"] is None and got["2023-09-30", "Tax Rate For Calcs"] == 0.21


def test_compact_statements(spark, tmp_path):
    cols = ["Fiscal Period", "Report Date", "Revenue", "Income Tax (Expense) Benefit, net", "Pretax Income (Loss), Adjusted"]
    data = [["Q1", "2023-03-31", "5", "-2", "10"], ["FY", "2022-12-31", "20", None, "10"], ["9M", "2023-09-30", "1", "1", "1"],
            ["Q1", "2023-03-31", "6"], ["Q2", "", "1", "1", "1"]]
    (tmp_path / "c.json").write_text(json.dumps({"ticker": "k", "statements": [{"columns": cols, "data": data}]}))
    got = {(r.freq, r.item): r.value for r in files.read_compact(spark, str(tmp_path / "c.json"), "income", {"Revenue": "Total Revenue"}).collect()}
    assert got == {("quarterly", "Total Revenue"): 6.0, ("quarterly", "Tax Rate For Calcs"): 0.21,
                   ("annual", "Total Revenue"): 20.0, ("annual", "Tax Rate For Calcs"): 0.21}


def test_wide_statement_nan_is_null(spark):
    df = spark.createDataFrame([("k", "Total Revenue", 1.0, float("nan"))], ["ticker", "item", "2023-12-31", "2023-09-30"])
    got = {str(r.period_end): r.value for r in files.wide_to_long(df, ["ticker"], "income", "quarterly").collect()}
    assert got == {"2023-12-31": 1.0, "2023-09-30": None}


def test_report_parsing(spark):
    text = {"a": ["PASSES 3 of 12", "7/12 filters, passes 8 of 12", "High conviction"], "b": ["Score: 11/12"],
            "c": ["10 of 12 filters pass"], "d": ["nothing"], "e": ["HIGH SIGNAL", "do not enter", "Score 12 / 12"]}
    rows = [(t, i, v) for t, vs in text.items() for i, v in enumerate(vs)]
    got = {r.ticker: (r.score, r.total, r.conviction) for r in files.parse_reports(
        spark.createDataFrame(rows, "ticker string, line_no int, value string")).collect()}
    assert got == {"a": (7, 12, "HIGH"), "b": (11, 12, "HIGH"), "c": (10, 12, "MEDIUM"), "d": (0, 12, "DO NOT ENTER"),
                   "e": (12, 12, "DO NOT ENTER")}


def test_report_files(spark, tmp_path):
    (tmp_path / "MSFT.txt").write_text("x\nPASSES 9 of 12 checks\n")
    assert tuple(files.read_reports(spark, str(tmp_path)).first()) == ("MSFT", 9, 12, "MEDIUM")


def test_insider_filings(spark):
    cols = ["Trade\xa0Date", "Insider\xa0Name", "Trade\xa0Type", "Value", "Ticker"]
    rows = [("2024-03-01 10:00", "n1", "P - Purchase", "+$1,234", "k"), ("2024-03-02", "n2", "S - Sale", "-$5", "k"),
            ("2023-01-01", "n3", "P - Purchase", "$9", "k"), ("2024-03-03", "n4", "P - Purchase", "n/a", "k")]
    p = files.insider_purchases(files.insider_columns(spark.createDataFrame(rows, cols)), F.lit("2024-03-10").cast("date"))
    from tidemark.operators.snapshots import insider_summary
    assert tuple(insider_summary(p).first()) == ("k", 2, 1234.0)
    assert [r.name for r in files.newest_purchases(p, 1).collect()] == ["n4"]


def test_trade_log_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ticker,entry_date,exit_date,Return %,Hold Days\nA,2024-01-01,bad,5.0,3\nB,2024-01-02,2024-02-01,-3.5,4\n")
    log = files.read_trades(spark, [str(tmp_path / "missing.csv"), str(tmp_path / "t.csv")])
    got = {r.ticker: r for r in log.collect()}
    assert got["A"].exit_date is None and got["A"].return_dec == pytest.approx(0.05) and got["B"].hold_days == 4
    assert got["A"].tier == "qvm"
    with pytest.raises(FileNotFoundError):
        files.read_trades(spark, [str(tmp_path / "none.csv")])
    sinks.write_trade_log(log, str(tmp_path / "out"), "m1")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).where("mode = 'm1'").count() == 2


def test_records_in_are_records_out_and_rejects(spark):
    lines = ['{"ticker": "A", "records": [{"date": "2024-03-31", "revenue": 1}, {"date": "2024-03-31 00:00", "revenue": 2.5, "netIncome": "x"}, '
             '{"date": "soon", "revenue": 3}, {"revenue": 4}, 7, null, {"date": "2024-06-30", "revenue": null, "grossProfit": "8"}]}',
             '{"ticker": "B", "records": [{"date": "2024-03-31", "rev', "", "[1, 2]", '{"records": []}', '{"ticker": "C", "records": {}}', '{"ticker": "D", "records": []}', '"text"']
    checked = files.checked_records(spark.createDataFrame([(x,) for x in lines], "value string")).cache()
    assert checked.where("level = 'line'").count() == 7 and checked.where("level = 'record'").count() == 7
    got = sorted((r.level, r.ticker or "", -1 if r.pos is None else r.pos, r.reason) for r in files.rejects(checked).collect())
    assert got == sorted([("record", "A", 0, "superseded"), ("record", "A", 2, "no date"), ("record", "A", 3, "no date"), ("record", "A", 4, "no object"),
                          ("record", "A", 5, "no object"), ("item", "A", 1, "no number: netIncome"), ("line", "", -1, "no JSON"), ("line", "", -1, "no JSON"),
                          ("line", "", -1, "no ticker"), ("line", "", -1, "no ticker"), ("line", "", -1, "no ticker"), ("line", "C", -1, "no records"), ("line", "D", -1, "no records")])
    used = {(str(r.period_end), r.item): r.value for r in files.used_records(checked, "income", "quarterly").where("value IS NOT NULL").collect()}
    assert used.pop(("2024-03-31", "Total Revenue")) == 2.5 and used.pop(("2024-06-30", "Gross Profit")) == 8.0
    assert {i for _, i in used} <= {"Tax Rate For Calcs"}


def test_state_versions_and_history(spark, tmp_path):
    root = str(tmp_path / "state")
    for v in (1, 2):
        sinks.write_state(spark.createDataFrame([("k", v)], "ticker string, score int"), root, v)
    assert sinks.read_state(spark, root).first().score == 2 and sinks.read_state(spark, root, 1).first().score == 1
    for d in ("2024-01-01", "2024-01-02"):
        sinks.append_scan(spark.createDataFrame([("k", 12, d)], "ticker string, score int, scan_date string"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).where("alert").count() == 2


def test_clean_bars(spark):
    rows = [("k", D(2024, 1, 1), 1.0, 1.0, 1.0, float("nan"), 1.0), ("k", D(2024, 1, 2), *[float("nan")] * 5), ("z", D(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)]
    b = spark.createDataFrame(rows + [("k", D(2024, 1, 3), 1.0, 1.0, 1.0, 1.0, 1.0)],
                              "ticker string, date date, open double, high double, low double, close double, volume double")
    got = files.clean_bars(b, 2).orderBy("date").collect()
    assert [(r.ticker, r.close) for r in got] == [("k", None), ("k", 1.0)]


def test_stale_sentiment_is_dropped(spark):
    s = spark.createDataFrame([(100.0, 30.0), (90000.0, 40.0)], "ts double, sentiment double")
    assert [r.sentiment for r in files.fresh_side_inputs(s, 90100.0).orderBy("ts").collect()] == [None, 40.0]
