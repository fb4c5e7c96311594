import numpy as np
from pyspark.sql import functions as F

from tidemark.operators.ranks import SUB_BINS, pct_rank_avg, value_ranks
from tidemark.functions.columns import order_bin


def test_ranks_of_values_within_one_percent_are_spread(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate((100 + rng.random(20_000), np.full(10_000, 100.5), [-3.0, 0.0]))
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double")
    got = {r.v: r.below for r in value_ranks(df, ["g"], "v").collect()}
    order = np.sort(v)
    assert all(got[float(x)] == np.searchsorted(order, x, "left") for x in v[::97])
    # no window partition holds more than a small part of the group
    most = df.distinct().groupBy(order_bin("v", 64 * SUB_BINS)).count().agg(F.max("count")).first()[0]
    assert most < 100
    half = pct_rank_avg(df, ["g"], "v", "p").where("v = 100.5").first().p
    lo, hi = np.searchsorted(order, 100.5, "left"), np.searchsorted(order, 100.5, "right")
    assert abs(half - (lo + 1 + hi) / 2 / len(v)) < 1e-12
