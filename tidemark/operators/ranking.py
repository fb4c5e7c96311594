"""Composite scores, top-N under a group cap, set comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.functions.columns import row_mean
from tidemark.operators.ranks import pct_rank_avg


def qvm_scores(members: DataFrame, by: str = "effective", cfg: Settings = DEFAULT) -> DataFrame:
    """Value and momentum scores of the watchlist members of each ``by``.

    The sub-metrics are stacked to long form, so one ranking pass serves all.
    ``original``: cheapness of P/S in its own history. ``composite``: mean of
    EBIT yield, P/S and FCF yield ranks with at most one missing. A lone
    member scores one half on both sides.
    """
    value = ["ps_pct"] if cfg.qvm_variant == "original" else ["ebit_yield", "ps_pct", "fcf_yield"]
    missing = sum((F.col(c).isNull().cast("int") for c in value), F.lit(0))
    usable = members.where(F.col("market_cap").isNotNull() & F.col("ret_6m").isNotNull()
                           & (missing < (1 if cfg.qvm_variant == "original" else 2)))
    long = usable.select(by, "ticker", *value, "ret_6m").unpivot(
        [by, "ticker"], [*value, "ret_6m"], "metric", "v")
    ranked = pct_rank_avg(long.where(F.col("v").isNotNull()), [by, "metric"], "v", "r")
    wide = ranked.groupBy(by, "ticker").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("r"))).alias(f"r_{m}") for m in [*value, "ret_6m"]])
    sizes = usable.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    cheap = [1 - F.col(f"r_{m}") if m == "ps_pct" else F.col(f"r_{m}") for m in value]
    alone = F.col("_n") == 1
    scored = (wide.join(sizes, by)
              .withColumn("value_score", F.when(alone, 0.5).otherwise(row_mean(cheap)))
              .withColumn("momentum_score", F.when(alone, 0.5).otherwise(F.col("r_ret_6m"))))
    return scored.select(by, "ticker", "value_score", "momentum_score",
                         (0.5 * F.col("value_score") + 0.5 * F.col("momentum_score")).alias("score"))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """Best ``n`` rows per group. Spark cuts each map partition to ``n`` rows
    per group before the shuffle, so a huge group costs its reducer little."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(out, rn).where(F.col(out) <= n).withColumn(out, F.col(out).cast("bigint"))


def top_n_capped(df: DataFrame, by: list[str], group: str, order: list[Column], n: int,
                 cap: float) -> DataFrame:
    """Best ``n`` per ``by`` with at most ``floor(cap * n)`` from one group. A
    rejected name never frees room, so filtering group ranks first is exact."""
    room = math.floor(cap * n + 1e-9)
    inside = top_n(df, [*by, group], order, room, "_group_rank")
    return top_n(inside, by, order, n).drop("_group_rank")


def last_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return top_n(df, by, order, k, "_k").drop("_k") if by else df.orderBy(*order).limit(k)


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Reproducible sample: the ``n`` keys with the smallest seeded md5."""
    draw = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return df.select(key).distinct().orderBy(draw, key).limit(n)


def board_order() -> list[Column]:
    """Alert tier, then score, then ticker."""
    s = F.coalesce(F.col("score"), F.lit(0))
    tier = F.when(s >= 11, 0).when(s >= 9, 1).otherwise(2)
    return [tier, s.desc(), F.col("ticker")]


def union_priority(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Everything of ``first`` and what only ``second`` has."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def dropped(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return previous.join(current.select(*keys), keys, "left_anti")


def prefer(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first provider that knows the key."""
    stacked = None
    for i, f in enumerate(frames):
        tagged = f.withColumn("_priority", F.lit(i))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    best = stacked.groupBy(key).agg(F.min("_priority").alias("_best"))
    return stacked.join(best, key).where(F.col("_priority") == F.col("_best")).drop("_priority", "_best")


def rebalance_diff(targets: DataFrame, periods: DataFrame) -> DataFrame:
    """BUY and SELL per period between consecutive target lists.

    ``targets`` (effective, ticker); ``periods`` (effective, previous) is the
    short list of rebalance dates, one row per quarter.
    """
    cur = targets.select("effective", "ticker").withColumn("held_now", F.lit(True))
    prev = (targets.select(F.col("effective").alias("previous"), "ticker")
            .join(periods, "previous").select("effective", "ticker").withColumn("held_before", F.lit(True)))
    both = cur.join(prev, ["effective", "ticker"], "full_outer")
    side = F.when(F.col("held_before").isNull(), "BUY").when(F.col("held_now").isNull(), "SELL")
    return both.select("effective", "ticker", side.alias("side")).where(F.col("side").isNotNull())
