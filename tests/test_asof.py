import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.asof import Stream
from tidemark.plans import pipelines as plans

D = dt.date


def test_column_and_row_asof_differ(spark):
    s = spark.createDataFrame([("k", D(2024, 1, 1), 1, 1), ("k", D(2024, 1, 2), 2, None), ("k", D(2024, 1, 3), 3, None)],
                              "ticker string, date date, a int, b int")
    p = spark.createDataFrame([("k", D(2024, 1, 3))], "ticker string, at date")
    col = asof.asof_backward(p, "ticker", "at", [Stream(s, "date", ["a", "b"])]).first()
    row = asof.asof_backward_row(p, s, "ticker", "at", ["a", "b"]).first()
    assert (col.a, col.b) == (3, 1) and (row.a, row.b) == (1, 1)


def test_never_a_later_row_and_same_day_counts(spark):
    s = spark.createDataFrame([("k", D(2024, 1, d), d) for d in (2, 5, 9)], "ticker string, date date, v int")
    p = spark.createDataFrame([("k", D(2024, 1, d)) for d in range(1, 12)] + [("z", D(2024, 1, 3))], "ticker string, at date")
    back = {(r.ticker, r.at.day): r.v for r in asof.asof_backward(p, "ticker", "at", [Stream(s, "date", ["v"])]).collect()}
    strict = {(r.ticker, r["at"].day): r.v for r in asof.asof_forward(p, s, "ticker", "at", "v").collect()}
    loose = {(r.ticker, r["at"].day): r.v for r in asof.asof_forward(p, s, "ticker", "at", "v", strict=False).collect()}
    for (t, d), v in back.items():
        want = [x for x in (2, 5, 9) if x <= d] if t == "k" else []
        assert v == (want[-1] if want else None)
        assert strict[t, d] == next((x for x in (2, 5, 9) if x > d and t == "k"), None)
        assert loose[t, d] == next((x for x in (2, 5, 9) if x >= d and t == "k"), None)


def test_availability_lag(spark):
    per = spark.createDataFrame([("k", D(2024, 3, 31))], "ticker string, period_end date")
    grid = spark.createDataFrame([("k", D(2024, 5, 14)), ("k", D(2024, 5, 15))], "ticker string, as_of date")
    got = asof.available_periods(grid, per, "ticker", "as_of", "period_end", 45).collect()
    assert [r.as_of for r in got] == [D(2024, 5, 15)]


def test_quarter_grid_edges(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-01-02', date'2024-07-10')) AS date").where("dayofweek(date) BETWEEN 2 AND 6")
    got = {r.quarter_end: (r.eval_date, r.effective) for r in plans.quarter_grid(days).collect()}
    # Quarter ends before the first day collapse onto it; the latest of them stays.
    assert got == {D(2023, 12, 31): (D(2024, 1, 2),) * 2, D(2024, 3, 31): (D(2024, 3, 29), D(2024, 4, 1)),
                   D(2024, 6, 30): (D(2024, 6, 28), D(2024, 7, 1))}


def test_calendar_alignment(spark):
    days = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 2, 4, 5)], "date date")
    s = spark.createDataFrame([("m", D(2024, 1, 2), 1.0), ("m", D(2024, 1, 5), 2.0)], "scenario string, date date, value double")
    got = [(r.date.day, r.value) for r in asof.align_to_calendar(s, days, "scenario", "value").orderBy("date").collect()]
    assert got == [(1, None), (2, 1.0), (4, 1.0), (5, 2.0)]


def test_scan_is_a_single_shuffle_by_key(spark):
    s = spark.range(100).select(F.lit("k").alias("ticker"), F.lit(D(2024, 1, 1)).alias("date"), F.col("id").alias("v"))
    p = spark.createDataFrame([("k", D(2024, 1, 3))], "ticker string, at date")
    df = asof.asof_backward(p, "ticker", "at", [Stream(s, "date", ["v"])])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
