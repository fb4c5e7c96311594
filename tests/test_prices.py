import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import prices
from tidemark.operators.ranks import nearest_to_percentile, pct_rank_avg, percentiles


def panel(spark, closes: dict, start="2019-01-01"):
    rows = []
    for t, xs in closes.items():
        days = pd.bdate_range(start, periods=len(xs))
        rows += [(t, d.date(), float(x), float(x) + 1, float(x) - 1, float(x), 10.0) for d, x in zip(days, xs)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(7)
    return {"A": 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 900))), "B": 5 + rng.random(300),
            "C": np.full(260, 3.3), "D": 50 + np.arange(119.0), "E": 50 + np.arange(120.0), "F": np.ones(59)}


def col(df, ticker, name):
    return df.where(F.col("ticker") == ticker).orderBy("date").select(name).toPandas()[name].to_numpy(dtype=float)


def test_ema_small_cases(spark):
    b = panel(spark, {"x": [10, 20, 30]})
    assert col(prices.with_ema(b, "close", {"e": 3}), "x", "e") == pytest.approx([10, 15, 22.5])
    assert col(prices.with_ema(b, "close", {"e": 3}, adjust=True), "x", "e") == pytest.approx([10, 50 / 3, 170 / 7])


@pytest.mark.parametrize("adjust", [False, True])
def test_ema_matches_pandas_across_years(spark, walk, adjust):
    got = prices.with_ema(panel(spark, walk), "close", {"e50": 50, "e200": 200}, adjust=adjust).cache()
    for t in ("A", "B"):
        for span in (50, 200):
            want = pd.Series(walk[t]).ewm(span=span, adjust=adjust).mean()
            assert col(got, t, f"e{span}") == pytest.approx(want.to_numpy(), rel=1e-12)


def test_ema_survives_long_histories(spark):
    # 25,000 rows: the one-window closed form would overflow for span 50.
    x = np.random.default_rng(1).random(25000) + 1
    rows = spark.createDataFrame(pd.DataFrame({"ticker": "L", "date": pd.date_range("1950-01-01", periods=len(x)).date, "close": x}))
    got = col(prices.with_ema(rows, "close", {"e": 50}), "L", "e")
    assert got == pytest.approx(pd.Series(x).ewm(span=50, adjust=False).mean().to_numpy(), rel=1e-11)


def test_rolling_features_match_pandas(spark, walk):
    got = prices.price_features(panel(spark, walk)).cache()
    assert got.where("ticker = 'F'").count() == 0  # 59 closes
    for t in "ABDE":
        s = pd.Series(walk[t])
        r = s.rolling(252, min_periods=120)
        np.testing.assert_allclose(col(got, t, "high_52w"), r.max(), rtol=1e-12)
        np.testing.assert_allclose(col(got, t, "zscore"), (s - r.mean()) / r.std().replace(0, np.nan), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(col(got, t, "ret_12_1"), s.shift(21) / s.shift(252) - 1, rtol=1e-12)
        np.testing.assert_allclose(col(got, t, "ret_6m"), s / s.shift(126) - 1, rtol=1e-12)
    assert np.isnan(col(got, "D", "high_52w")).all() and col(got, "E", "high_52w")[-1] == 169
    assert np.isnan(col(got, "C", "zscore")).all()  # constant closes: deviation 0


def test_atr(spark, walk):
    b = panel(spark, {"A": walk["A"][:60]})
    c = walk["A"][:60]
    tr = np.maximum(2.0, np.maximum(abs(c[1:] + 1 - c[:-1]), abs(c[1:] - 1 - c[:-1])))
    got = col(prices.with_atr(b), "A", "atr")
    assert np.isnan(got[:22]).all()
    np.testing.assert_allclose(got[22:], pd.Series(tr).rolling(22).mean().to_numpy()[21:], rtol=1e-12)


def test_null_closes_are_skipped(spark):
    b = panel(spark, {"A": range(1, 80)}).withColumn("close", F.when(F.col("close") != 40, F.col("close")))
    f = prices.price_features(b)
    assert f.count() == 78
    assert col(f, "A", "ema_50") == pytest.approx(pd.Series([x for x in range(1, 80) if x != 40], dtype=float).ewm(span=50, adjust=False).mean())


def test_live_snapshot_uses_row_126_back(spark, walk):
    s = prices.live_snapshot(panel(spark, {"A": walk["A"]})).first()
    last_year = pd.Series(walk["A"], index=pd.bdate_range("2019-01-01", periods=900))
    last_year = last_year[last_year.index > last_year.index[-1] - pd.Timedelta(days=365)]
    assert s.mom_6m == pytest.approx((last_year.iloc[-1] / last_year.iloc[-126] - 1) * 100)
    assert s.ema50 == pytest.approx(last_year.ewm(span=50).mean().iloc[-1])
    assert s.high_52w == last_year.max()


def test_run_length(spark):
    b = panel(spark, {"A": [1, 2, 3, 1, 2, 2]})
    got = prices.run_length(b.withColumn("up", F.col("close") > 1), F.col("up"), "run")
    assert col(got, "A", "run").tolist() == [0, 1, 2, 0, 1, 2]


def test_rank_average_ties(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 3.0), ("g", None)], "k string, v double")
    got = sorted((r.r for r in pct_rank_avg(df, ["k"], "v", "r").collect()), key=lambda x: (x is None, x))
    assert got == [0.5, 0.5, 1.0, None]


def test_ranks_and_percentiles_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 50, n).astype(str)),
                        "v": np.where(rng.random(n) < 0.3, -7.5, rng.normal(0, 1000, n)), "id": range(n)})
    df = spark.createDataFrame(pdf)
    got = pct_rank_avg(df, ["k"], "v", "r").toPandas().sort_values("id")
    np.testing.assert_allclose(got.r, pdf.groupby("k").v.rank(pct=True))
    assert got.r.between(0, 1, inclusive="right").all()
    q = percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).toPandas().set_index("k")
    for name, p in (("a", 5), ("b", 50), ("c", 95)):
        want = pdf.groupby("k").v.apply(lambda x: np.percentile(x, p))
        np.testing.assert_allclose(q[name].sort_index(), want.sort_index(), rtol=1e-12)
    again = pct_rank_avg(df.repartition(13), ["k"], "v", "r").toPandas().sort_values("id")
    assert (again.r.to_numpy() == got.r.to_numpy()).all()


def test_nearest_to_percentile(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(101)], "sim long, v double")
    got = {r.point: r.sim for r in nearest_to_percentile(df, "sim", "v", {"lo": 0.05, "mid": 0.5}).collect()}
    assert got == {"lo": 5, "mid": 50}
