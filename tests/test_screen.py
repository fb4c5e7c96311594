import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.operators import exits, filters, ranking, snapshots
from tidemark.operators.prices import with_atr

D = dt.date


@pytest.mark.parametrize("group, flags, want", [
    ("F8", "TFFN", False), ("F8", "TTNN", True), ("F8", "NNNN", None),
    ("F9", "FN", False), ("F9", "NN", None), ("F9", "NT", True),
    ("F1", "TN", True), ("F1", "NN", None), ("F1", "TF", False),
    ("F3", "N", None), ("F3", "T", True), ("F3", "F", False)])
def test_group_logic(spark, group, flags, want):
    val = {"T": True, "F": False, "N": None}
    df = spark.createDataFrame([("k", group, val[f]) for f in flags], "ticker string, grp string, passed boolean")
    assert filters.rollup_checks(df, ["ticker"]).first().group_pass is want


@pytest.mark.parametrize("vix, off, want", [(35.0, 0.30, "EXTREME"), (25.0, 0.20, "HIGH"), (24.0, 0.5, "MODERATE"), (None, 0.5, "MODERATE")])
def test_signal_conviction(spark, vix, off, want):
    df = spark.createDataFrame([(vix, off)], "v double, o double")
    assert df.select(filters.signal_conviction(F.col("v"), F.col("o"))).first()[0] == want


def test_nan_never_passes_a_filter(spark):
    from tidemark.functions.columns import nan_to_null
    df = spark.createDataFrame([(float("nan"),)], "x double")
    assert df.select((F.col("x") > 0.15).alias("raw"), (nan_to_null("x") > 0.15).alias("safe")).first() == (True, None)


def test_action_labels(spark):
    df = spark.createDataFrame([(12, []), (11, ["F8"]), (11, ["F12"]), (11, ["F3"]), (9, ["F1"]), (8, [])], "n int, f array<string>")
    got = [r[0] for r in df.select(filters.next_action(F.col("n"), F.col("f"))).collect()]
    assert got == ["SIGNAL ACTIVE", "WATCHLIST PRIORITY", "STABILIZATION WATCH", "WATCH LIST", "WATCH LIST", "NO ACTION"]


def test_market_state_votes(spark):
    days = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 2)], "date date")
    vix = spark.createDataFrame([(D(2024, 1, 1), 30.0)], "date date, vix double")
    bench = spark.createDataFrame([(D(2024, 1, 1), 1.0, 1.0, 1.0, 0.2, 0.0)],
                                  "date date, close double, ema_200 double, high_rolling double, below_trend double, drawdown double")
    side = spark.createDataFrame([(D(2024, 1, 2), 10.0, "red")], "date date, sentiment double, regime string")
    a, b = filters.market_state(days, bench, vix, side, "2024-01-02").orderBy("date").collect()
    assert (a.fear_count, a.f8_fear_regime) == (2, True)
    assert (b.fear_count, b.f8_fear_regime) == (3, False)  # sentiment votes, regime blocks
    old = filters.market_state(days, bench, vix, side, "2025-01-02").orderBy("date").collect()
    assert old[1].fear_count == 2  # sentiment is too far from today


def test_cap_from_an_empty_book(spark):
    rows = [("q", f"{s}{i}", s, float(100 - 10 * i - ord(s))) for s in "xyz" for i in range(4)]
    df = spark.createDataFrame(rows, "q string, ticker string, sector string, score double")
    got = ranking.top_n_capped(df, ["q"], "sector", [F.col("score").desc(), F.col("ticker")], 10, 0.35)
    assert got.count() == 9 and {r["count"] for r in got.groupBy("sector").count().collect()} == {3}


def test_lone_survivor_scores_half(spark):
    cols = "effective int, ticker string, market_cap double, ret_6m double, ebit_yield double, ps_pct double, fcf_yield double"
    df = spark.createDataFrame([(1, "a", 1.0, 0.1, 0.1, 0.5, 0.1), (2, "a", 1.0, 0.1, None, 0.5, 0.3), (2, "b", 1.0, 0.2, 0.2, None, 0.1),
                                (2, "c", 1.0, 0.3, None, None, 0.1), (2, "d", None, 0.3, 1.0, 1.0, 0.1)], cols)
    got = {(r.effective, r.ticker): (r.value_score, r.momentum_score, r.score) for r in ranking.qvm_scores(df).collect()}
    assert got[1, "a"] == (0.5, 0.5, 0.5)
    assert set(got) == {(1, "a"), (2, "a"), (2, "b")}  # two missing, or no cap: excluded
    assert got[2, "a"] == ((0.0 + 1.0) / 2, 0.5, 0.5) and got[2, "b"] == ((1.0 + 0.5) / 2, 1.0, 0.875)


def test_changes_and_state(spark):
    last = spark.createDataFrame([("A", 11), ("B", 12), ("C", 11), ("E", 12)], "ticker string, score int")
    now = spark.createDataFrame([("A", 12), ("B", 12), ("C", 10), ("D", 11), ("F", 3)], "ticker string, score int")
    got = {(r.ticker, r.change) for r in snapshots.detect_changes(now, last).collect()}
    assert got == {("A", "CHANGED"), ("C", "REMOVED"), ("D", "NEW"), ("E", "REMOVED")}
    state = snapshots.next_state(now)
    assert {(r.ticker, r.score) for r in state.collect()} == {("A", 12), ("B", 12), ("D", 11)}
    assert snapshots.detect_changes(state, state).count() == 0


def test_provider_precedence_and_sets(spark):
    a = spark.createDataFrame([("x", 1)], "ticker string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 2), ("y", 3)], "ticker string, v int")
    assert sorted(map(tuple, ranking.prefer([a, b], "ticker").collect())) == [("x", 1), ("y", 2), ("y", 3)]
    assert sorted(map(tuple, ranking.union_priority(a, b, "ticker").collect())) == [("x", 1), ("y", 2), ("y", 3)]


def bars_of(spark, closes, highs=None, lows=None):
    n = len(closes)
    pdf = pd.DataFrame({"ticker": "k", "date": pd.date_range("2024-01-01", periods=n).date, "close": closes,
                        "high": closes if highs is None else highs, "low": closes if lows is None else lows})
    return spark.createDataFrame(pdf)


def test_stops_against_brute_force(spark):
    rng = np.random.default_rng(5)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 260)))
    b = bars_of(spark, c, c * 1.01, c * 0.99)
    atr = [r.atr for r in with_atr(b).orderBy("date").collect()]
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(len(c))]
    starts = [0, 7, 40, 111, 200]
    e = spark.createDataFrame([("k", days[i]) for i in starts], "ticker string, entry_date date")
    got = {r.entry_date: r for r in exits.stop_exits(e, b).collect()}
    for i in starts:
        fixed = next((days[j] for j in range(i, len(c)) if c[j] < max(c[i:j + 1]) * 0.85), None)
        chand = next((days[j] for j in range(i, len(c)) if j - i >= 30 and atr[j] is not None
                      and c[j] < max(c[i:j + 1]) - 3 * atr[j]), None)
        assert (got[days[i]].trailing_date, got[days[i]].atr_date) == (fixed, chand)


def test_exit_precedence_by_tier(spark):
    b = bars_of(spark, [100.0] * 40 + [50.0] * 5)
    e = spark.createDataFrame([("k", t, D(2024, 1, 2), 100.0) for t in ("qvm", "crash")],
                              "ticker string, tier string, entry_date date, entry_price double")
    states = spark.createDataFrame([("k", D(2024, 1, 10), None), ("k", D(2024, 2, 1), "gm_below_30%")],
                                   "ticker string, published date, reason string")
    got = {r.tier: r for r in exits.resolve_exits(e, b, states, method="fixed").collect()}
    assert (got["qvm"].exit_reason, got["qvm"].exit_date, got["qvm"].exit_price) == ("trailing_stop", D(2024, 2, 10), 50.0)
    assert (got["crash"].exit_reason, got["crash"].exit_date) == ("gm_below_30%", D(2024, 2, 1))
    reb = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 20),)], "effective date")
    tgt = spark.createDataFrame([(D(2024, 1, 5), "k")], "effective date, ticker string")
    q = {r.tier: r for r in exits.resolve_exits(e, b, states, reb, tgt, method="fixed").collect()}["qvm"]
    assert (q.exit_reason, q.exit_date) == ("qvm_rebalance", D(2024, 1, 20))
    open_end = exits.resolve_exits(e.where("tier = 'crash'"), b).first()
    assert open_end.exit_reason == "backtest_end" and open_end.exit_date == D(2024, 2, 14)


def test_stops_have_no_age_limit(spark):
    b = bars_of(spark, [100.0] * 2000 + [40.0] * 100)
    e = spark.createDataFrame([("k", "qvm", D(2024, 1, 2), 100.0)], "ticker string, tier string, entry_date date, entry_price double")
    got = exits.resolve_exits(e, b, method="fixed").first()
    assert (got.exit_reason, got.exit_date) == ("trailing_stop", D(2024, 1, 1) + dt.timedelta(days=2000))


def test_rebalance_diff(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "effective int, ticker string")
    p = spark.createDataFrame([(2, 1)], "effective int, previous int")
    got = {tuple(r) for r in ranking.rebalance_diff(t, p).collect()}
    assert got == {(1, "a", "BUY"), (1, "b", "BUY"), (2, "c", "BUY"), (2, "a", "SELL")}


def test_positions(spark):
    p = spark.createDataFrame([("a", 10.0, 100.0, None, 40.0), ("b", 0.0, 5.0, 10.0, 10.0)],
                              "ticker string, shares double, entry_price double, stop_pct double, weight double")
    latest = spark.createDataFrame([("a", 110.0), ("b", 1.0)], "ticker string, price double")
    m = snapshots.mark_to_market(p, latest)
    assert m.where("ticker = 'a'").select("pnl", "pnl_pct", "stop_price").first() == pytest.approx((100.0, 10.0, 85.0))
    assert snapshots.portfolio_totals(m).first().positions == 1
    u = spark.createDataFrame([("a", "Tech")], "ticker string, sector string")
    assert {(r.sector, r.status) for r in snapshots.sector_allocation(p, u).collect()} == {("Tech", "OVER"), ("Unknown", "OK")}
