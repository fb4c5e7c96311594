import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, curves, trades, walkforward

D = dt.date


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(11)
    n = 700
    # A third of all trades starts on one day.
    day = np.where(rng.random(n) < 0.33, 400, rng.integers(0, 1800, n))
    pdf = pd.DataFrame({
        "ticker": [f"t{i}" for i in range(n)], "tier": np.where(rng.random(n) < 0.7, "qvm", "crash"),
        "entry_date": [D(2018, 1, 1) + dt.timedelta(days=int(d)) for d in day], "return_dec": rng.normal(0.01, 0.1, n)})
    pdf["exit_date"] = [d + dt.timedelta(days=20) for d in pdf.entry_date]
    pdf["return_pct"], pdf["hold_days"], pdf["pnl_dollars"] = pdf.return_dec * 100, 20, pdf.return_dec * 1e5
    pdf["exit_reason"] = np.where(rng.random(n) < 0.05, "backtest_end", "trailing_stop")
    return pdf, spark.createDataFrame(pdf).cache()


def in_order(pdf):
    return pdf.assign(h=[hashlib.md5(t.encode()).hexdigest() for t in pdf.ticker]).sort_values(["entry_date", "h"])


def test_compounding_case(spark):
    t = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 2, 1), 0.1), ("b", D(2024, 1, 2), D(2024, 2, 1), -0.2)],
                              "ticker string, entry_date date, exit_date date, return_dec double")
    got = [r.equity for r in trades.trade_curve(t).orderBy("entry_date").collect()]
    assert got == pytest.approx([1_010_000, 989_800])


def test_curve_matches_a_plain_loop(log):
    pdf, df = log
    o = in_order(pdf)
    eq = 1e6 * np.cumprod(1 + 0.1 * o.return_dec.to_numpy())
    dd = eq / np.maximum.accumulate(np.r_[1e6, eq])[1:] - 1
    got = trades.trade_curve(df).toPandas().set_index("ticker").loc[o.ticker]
    np.testing.assert_allclose(got.equity, eq, rtol=1e-12)
    np.testing.assert_allclose(got.drawdown, dd, atol=1e-12)


def test_period_metrics_match_a_plain_loop(spark, log):
    pdf, df = log
    bench = spark.createDataFrame([(y, 10.0) for y in range(2018, 2022)], "year long, ret_pct double")
    got = walkforward.walk_forward(df, bench).toPandas()
    closed = in_order(pdf[pdf.exit_reason != "backtest_end"])
    year = pd.to_datetime(closed.entry_date).dt.year
    assert sorted(got.kind.unique()) == ["half", "test", "train", "year"]
    for r in got.itertuples():
        t = closed[(year >= r.start_year) & (year < r.end_year)]
        x = t.return_dec.to_numpy()
        eq = np.r_[1.0, np.cumprod(1 + 0.1 * x)]
        years = max((D(r.end_year, 1, 1) - D(r.start_year, 1, 1)).days / 365.25, 0.5)
        assert r.n_trades == len(t) and r.n_qvm == (t.tier == "qvm").sum()
        assert r.cagr == pytest.approx((eq[-1] ** (1 / years) - 1) * 100)
        assert r.max_drawdown == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min() * 100)
        assert r.sharpe == pytest.approx((x * .1).mean() / (x * .1).std() * np.sqrt(len(x) / years))
        assert r.median_return == pytest.approx(np.median(t.return_pct))
        assert r.profit_factor == pytest.approx(x[x > 0].sum() / abs(x[x <= 0].sum()))
    assert got[(got.kind == "year") & (got.start_year == 2022)].bench_cagr.item() == 0  # no benchmark year


def test_profit_factor_edges(spark):
    rows = [("a", "qvm", D(2018, 2, 1), 0.1), ("b", "qvm", D(2019, 2, 1), 0.1), ("c", "qvm", D(2019, 3, 1), 0.0)]
    t = spark.createDataFrame(rows, "ticker string, tier string, entry_date date, return_dec double").select(
        "*", F.col("entry_date").alias("exit_date"), (F.col("return_dec") * 100).alias("return_pct"), F.lit(1).alias("hold_days"))
    per = spark.createDataFrame([(str(y), "year", 1, y, y + 1) for y in (2018, 2019)],
                                "period string, kind string, fold long, start_year long, end_year long")
    bench = spark.createDataFrame([(2018, 1.0)], "year long, ret_pct double")
    got = {r.period: r for r in trades.period_metrics(t, per, bench).collect()}
    assert got["2018"].profit_factor == pytest.approx(10) and got["2018"].sharpe == 0  # no losers: over 1
    assert got["2019"].profit_factor == float("inf")  # losers sum to zero


def test_tier_years_and_metrics(log):
    pdf, df = log
    row = trades.closed_metrics(df, []).first()
    closed = pdf[pdf.exit_reason != "backtest_end"]
    assert row.win_rate == pytest.approx((closed.return_dec > 0).mean()) and row.total_trades == len(pdf)
    assert {r.tier for r in walkforward.tier_years(df).collect()} == {"qvm", "crash"}
    assert {r.tier: r.n for r in trades.trade_stats(df).collect()}[None] == len(pdf)


def test_bootstrap_is_reproducible_and_exact(spark, log):
    pdf, df = log
    n = bootstrap.numbered(df, ["entry_date", "ticker"]).select("idx", "return_dec").cache()
    by_idx = {r.idx: r.return_dec for r in n.collect()}
    assert sorted(by_idx) == list(range(len(pdf)))
    a = bootstrap.simulate(n, 3).orderBy("sim").toPandas()
    b = bootstrap.simulate(n.repartition(7), 3).orderBy("sim").toPandas()
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)
    for sim in range(3):
        x = np.array([by_idx[int(hashlib.md5(f"{sim}-{d}-42".encode()).hexdigest()[:8], 16) % len(pdf)] for d in range(len(pdf))])
        eq = np.r_[1.0, np.cumprod(1 + 0.1 * x)]
        assert a.final_value[sim] == pytest.approx(eq[-1] * 1e6)
        assert a.max_drawdown[sim] == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min())
        assert a.sharpe[sim] == pytest.approx(x.mean() / x.std() * np.sqrt(len(x) / 5))
        assert a.win_rate[sim] == pytest.approx((x > 0).mean())


def test_folded_and_joined_blocks_agree(spark, log, monkeypatch):
    n = bootstrap.numbered(log[1], ["entry_date", "ticker"]).select("idx", "return_dec").cache()
    monkeypatch.setattr(bootstrap, "CHUNK_DRAWS", 64)  # several blocks a simulation
    folded = bootstrap.simulate(n, 5).orderBy("sim").toPandas()
    monkeypatch.setattr(bootstrap, "BROADCAST_TRADES", 10)
    pd.testing.assert_frame_equal(folded, bootstrap.simulate(n, 5).orderBy("sim").toPandas(), rtol=1e-9)
    assert bootstrap.simulate(n.limit(0), 5).count() == 0


def test_hashes_of_a_block_are_those_of_its_texts():
    for sim, low, high, seed in ((0, 0, 1100, 42), (987, 99_990, 100_010, 42), (9_999, 5_600_000, 5_600_100, 7), (10**18, 15_999_990, 16_000_000, 42)):
        want = [int(hashlib.md5(f"{sim}-{d}-{seed}".encode()).hexdigest()[:8], 16) for d in range(low, high + 1)]
        assert bootstrap._hashes(seed)(sim, low, high).tolist() == want


def test_lists_too_long_to_broadcast_are_folded_without_a_row_per_draw(spark, monkeypatch):
    n = spark.range(3000).selectExpr("id AS idx", "(id % 700 - 340) / 1000 AS return_dec").cache()
    monkeypatch.setattr(bootstrap, "CHUNK_DRAWS", 512)
    monkeypatch.setattr(bootstrap, "BROADCAST_TRADES", 10)
    monkeypatch.setattr(bootstrap, "LISTED_TRADES", 10)
    joined = bootstrap.simulate(n, 4).orderBy("sim").toPandas()
    monkeypatch.setattr(bootstrap, "LISTED_TRADES", 3000)
    monkeypatch.setattr(bootstrap, "PIECE_TRADES", 700)
    monkeypatch.setattr(bootstrap, "TASK_DRAWS", 4000)  # several groups

    def no_rows(*a):
        raise AssertionError("a row per draw")
    monkeypatch.setattr(bootstrap, "draws", no_rows)
    pd.testing.assert_frame_equal(joined, bootstrap.simulate(n, 4).orderBy("sim").toPandas(), rtol=1e-9)


def test_chosen_paths_are_drawn_again_alone(spark, log):
    pdf, df = log
    n = bootstrap.numbered(df, ["entry_date", "ticker"]).select("idx", "return_dec").cache()
    by_idx = {r.idx: r.return_dec for r in n.collect()}
    stats = {r.sim: r for r in bootstrap.simulate(n, 9).collect()}
    chosen = spark.createDataFrame([("a", 7), ("b", 2), ("c", 7)], "point string, sim long")
    got = bootstrap.drawn_paths(n, chosen).toPandas()
    assert len(got) == 3 * len(pdf)
    for point, sim in (("a", 7), ("b", 2), ("c", 7)):
        own = got[got.point == point].sort_values("draw")
        x = np.array([by_idx[int(hashlib.md5(f"{sim}-{d}-42".encode()).hexdigest()[:8], 16) % len(pdf)] for d in range(len(pdf))])
        np.testing.assert_allclose(own.equity, 1e6 * np.cumprod(1 + 0.1 * x), rtol=1e-9)
        assert own.equity.iloc[-1] == pytest.approx(stats[sim].final_value) and own.drawdown.min() == pytest.approx(stats[sim].max_drawdown)


def test_rescaled_logs(spark):
    pct = spark.createDataFrame([(5.0,), (-3.0,)], "return_pct double")
    frac = spark.createDataFrame([(0.05,), (-0.03,)], "return_pct double")
    for df in (pct, frac):
        assert sorted(r.return_dec for r in trades.rescaled(df).collect()) == pytest.approx([-0.03, 0.05])


def test_drawdown_and_metrics_case(spark):
    c = spark.createDataFrame([("m", D(2024, 1, i + 1), v) for i, v in enumerate((100.0, 120.0, 90.0, 130.0))],
                              "scenario string, date date, value double")
    got = [r.drawdown for r in curves.with_drawdown(c).orderBy("date").collect()]
    assert got == pytest.approx([0, 0, -0.25, 0]) and curves.curve_metrics(c).first().max_drawdown == pytest.approx(-0.25)
    assert curves.curve_metrics(c).first().sharpe is None  # fewer than 20 returns


def test_curves_align_on_the_benchmark_days(spark):
    day = lambda k: D(2024, 1, k)
    model = spark.createDataFrame([("m", day(2), 10.0), ("m", day(3), 11.0), ("m", day(6), 12.0), ("m", day(7), 99.0)], "scenario string, date date, value double")
    bench = spark.createDataFrame([("b", day(k), float(k)) for k in (1, 2, 4, 5, 6, 8)], "scenario string, date date, value double")
    got = {r.date.day: (r.model, r.bench) for r in curves.align(model, bench).collect()}
    # the model's days 3 and 7 are no benchmark days
    assert got == {1: (None, 1.0), 2: (10.0, 2.0), 4: (10.0, 4.0), 5: (10.0, 5.0), 6: (12.0, 6.0), 8: (12.0, 8.0)}


def test_exit_dated_curve_keeps_every_trade(spark):
    import hashlib
    import random
    rng = random.Random(4)
    rows = [(f"t{k}", "qvm", D(2020, 1, 1 + k % 20), D(2020, 2, 1 + rng.randrange(3)), rng.uniform(-0.5, 0.5)) for k in range(80)]
    df = spark.createDataFrame(rows, "ticker string, tier string, entry_date date, exit_date date, return_dec double")
    entry = sorted(rows, key=lambda r: (r[2], hashlib.md5(r[0].encode()).hexdigest()))
    equity, v = {}, 1e6
    for place, r in enumerate(entry):
        v *= 1 + 0.1 * r[4]
        equity[r[0]] = (r[3], place, v)
    peak, want = 1e6, {}
    for t, (_, _, v) in sorted(equity.items(), key=lambda x: x[1][:2]):
        peak = max(peak, v)
        want[t] = v / peak - 1
    got = {r.ticker: r.drawdown for r in trades.exit_dated_curve(df, []).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
