import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters, metrics, statements
from tidemark.operators.asof import Stream, asof_backward

D = dt.date
QUARTERS = [D(y, m, d) for y in (2021, 2022, 2023) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]


def long(spark, items: dict, freq="quarterly", ticker="k", last=D(2023, 12, 31)):
    """items: label -> values newest first."""
    known = statements.label_lookup()
    q = [d for d in QUARTERS if d <= last] if freq == "quarterly" else [D(y, 12, 31) for y in range(2015, 2024)]
    rows = [(ticker, freq, known[label][0], q[-1 - i], label, None if v is None else float(v))
            for label, vs in items.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "ticker string, freq string, statement string, period_end date, item string, value double")


def at(spark, frame, as_of=D(2024, 6, 1), close=10.0, shares=100.0):
    grid = spark.createDataFrame([("k", as_of)], "ticker string, as_of date")
    states = Stream(statements.statement_states(statements.period_table(frame)), "published", statements.STATE_COLS)
    seen = asof_backward(grid, "ticker", "as_of", [states])
    seen = seen.withColumn("close", F.lit(close)).withColumn("shares_used", F.lit(shares))
    return metrics.with_metrics(seen)


def test_growth_pair_and_filter(spark):
    row = filters.with_quality_filters(at(spark, long(spark, {"Total Revenue": [130, 125, 120, 110, 100]}))).first()
    assert row.g1 == pytest.approx(0.30) and row.g2 is None and row.f1_rev_growth is True
    assert row.quality_pass is False


def test_position_not_calendar(spark):
    f = long(spark, {"Total Revenue": [130, 125, 120, 110, 100, 50]}).where("period_end <> date'2023-06-30'")
    assert at(spark, f).first().g1 == pytest.approx(130 / 50 - 1)


def test_roic_default_tax(spark):
    f = long(spark, {"Operating Income": [10, 10, 10, 10], "Total Assets": [300], "Current Liabilities": [100],
                     "Cash And Cash Equivalents": [40]})
    row = filters.with_quality_filters(at(spark, f)).first()
    assert row.roic == pytest.approx(31.6 / 180) and row.f3_roic is True


def test_tax_in_percent_is_scaled_and_clamped(spark):
    base = {"Operating Income": [10, 10, 10, 10], "Total Assets": [200], "Current Liabilities": [100]}
    for rate, want in ((25, 0.25), (0.9, 0.6), (-1, 0.0)):
        f = long(spark, {**base, "Tax Rate For Calcs": [rate]})
        assert at(spark, f).first().roic == pytest.approx(40 * (1 - want) / 100)


@pytest.mark.parametrize("capex", [10, -10])
def test_free_cash_flow_sign(spark, capex):
    f = long(spark, {"Operating Cash Flow": [50, 0, 0, 0], "Capital Expenditure": [capex, 0, 0, 0]})
    assert at(spark, f).first().fcf == 40


def test_missing_capex_counts_as_zero(spark):
    assert at(spark, long(spark, {"Operating Cash Flow": [50, 0, 0, 0]})).first().fcf == 50


def test_runway(spark):
    f = long(spark, {"Operating Cash Flow": [0], "Cash And Cash Equivalents": [5]})
    assert at(spark, f).first().runway == 999
    f = long(spark, {"Operating Cash Flow": [-12], "Cash And Cash Equivalents": [24]})
    assert at(spark, f).first().runway == 24


def test_ttm_of_nulls_is_zero_but_annual_stays_null(spark):
    assert at(spark, long(spark, {"Total Revenue": [None] * 4})).first().revenue_ttm == 0.0
    assert at(spark, long(spark, {"Total Revenue": [None] * 4}, "annual")).first().revenue_ttm is None


def test_falling_run(spark):
    row = at(spark, long(spark, {"Total Revenue": [90, 95, 110, 120, 100, 100, 100, 100]})).first()
    assert row.falling == 2
    from tidemark.operators.exits import thesis_break
    assert at(spark, long(spark, {"Total Revenue": [90, 95, 110, 120, 100, 100, 100, 100]})).select(
        thesis_break().alias("r")).first().r == "neg_revenue_2q"


def test_first_present_label_wins_even_when_null(spark):
    f = long(spark, {"Total Revenue": [None, 5], "Revenue": [7, 7]})
    rows = {r.period_end: r.value for r in statements.resolve_labels(f).where("item = 'revenue'").collect()}
    assert rows == {D(2023, 12, 31): None, D(2023, 9, 30): 5.0}


def test_annual_fallback_below_four_quarters(spark):
    q = long(spark, {"Operating Income": [10, 10, 10]})
    a = long(spark, {"Operating Income": [100, 90]}, "annual")
    row = at(spark, q.unionByName(a)).first()
    assert row.income_freq == "annual" and row.ebit_ttm == 100


def test_ev_treats_missing_debt_and_cash_as_zero(spark):
    f = long(spark, {"Operating Income": [10, 10, 10, 10], "Stockholders Equity": [5]})
    row = at(spark, f).first()
    assert row.ev == 1000 and row.ebit_yield == pytest.approx(0.04) and row.de_ratio is None


def test_peg_falls_back_to_annual_growth(spark):
    q = long(spark, {"Net Income": [10, 10, 10, 10]})
    a = long(spark, {"Net Income": [40, 20]}, "annual")
    row = at(spark, q.unionByName(a)).first()
    assert row.pe == 25 and row.peg == pytest.approx(25 / 100)


def test_no_look_ahead(spark):
    items = {"Total Revenue": [130, 125, 120, 110, 100, 90], "Net Income": [5, 4, 3, 2, 1, 1]}
    early = D(2024, 1, 31)
    past = long(spark, {k: v[1:] for k, v in items.items()}, last=D(2023, 9, 30))
    assert at(spark, long(spark, items), early).first() == at(spark, past, early).first()


def test_ps_history_percentiles(spark):
    hist = spark.createDataFrame([([1.0, 2.0, 2.0, 4.0], 2.0), ([1.0, 2.0, 4.0, 9.0], 1.5), ([3.0], 1.0)], "ps_hist array<double>, ps double")
    a, b, c = metrics.with_ps_stats(hist).collect()
    assert (a.ps_pct, a.ps_rank, a.ps_min, a.ps_max) == (0.75, 25, 1.0, 4.0)
    assert b.ps_threshold == pytest.approx(1.75)
    assert c.ps_pct is None and c.ps_threshold is None and c.ps_n == 1


def test_ps_history_window_and_annual_switch(spark):
    grid = spark.createDataFrame([("k", D(2024, 1, 1))], "ticker string, as_of date")
    pts = [("k", D(2020, 12, 1), 9.0, None), ("k", D(2021, 6, 1), 1.0, None), ("k", D(2023, 6, 1), 2.0, None), ("k", D(2024, 2, 1), 8.0, None)]
    pts += [("k", D(y, 3, 1), None, float(y)) for y in (2021, 2022, 2023)]
    p = spark.createDataFrame(pts, "ticker string, published date, ps_q double, ps_a double")
    assert sorted(statements.with_ps_history(grid, p).first().ps_hist) == [2021.0, 2022.0, 2023.0]
    few = p.where("ps_a IS NULL OR ps_a > 2021")
    assert sorted(statements.with_ps_history(grid, few).first().ps_hist) == [1.0, 2.0]
