"""Exact order statistics that never sort a whole group in one task.

Values are counted per (group, value) with map-side combine, ranked inside
value buckets (``order_bin``), and the bucket offsets are summed up. A group
holding a third of all rows, or a single value repeated for a third of the
rows, is therefore spread over many tasks and the ranks stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import order_bin

#: Parts of a value bucket.
SUB_BINS = 4096


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per (group, distinct value): ``cnt`` rows have it, ``below``
    rows of the group are smaller, the group has ``n`` non-null rows."""
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))
              .withColumn("_bin", order_bin(value)).withColumn("_sub", order_bin(value, 64 * SUB_BINS)))
    # Three levels: buckets of a group, at most SUB_BINS parts of a bucket, values of a part. A group whose
    # values lie within one percent is one bucket, but still thousands of parts.
    inside = Window.partitionBy(*by, "_sub").orderBy(value)
    local = counts.withColumn("_local", F.sum("cnt").over(inside) - F.col("cnt"))
    within = Window.partitionBy(*by, "_bin").orderBy("_sub")
    subs = (counts.groupBy(*by, "_bin", "_sub").agg(F.sum("cnt").alias("_sub_n"))
            .withColumn("_earlier", F.sum("_sub_n").over(within) - F.col("_sub_n")))
    across = Window.partitionBy(*by)
    bins = (counts.groupBy(*by, "_bin").agg(F.sum("cnt").alias("_bin_n"))
            .withColumn("_before", F.sum("_bin_n").over(across.orderBy("_bin")) - F.col("_bin_n"))
            .withColumn("n", F.sum("_bin_n").over(across)))
    return (local.join(subs.select(*by, "_sub", "_earlier"), [*by, "_sub"]).join(bins, [*by, "_bin"])
            .select(*by, value, "cnt", (F.col("_before") + F.col("_earlier") + F.col("_local")).alias("below"), "n"))


def pct_rank_avg(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Percentile rank with ties at their average rank; NULL stays NULL."""
    ranks = value_ranks(df, by, value).select(
        *by, value, ((F.col("below") + (F.col("cnt") + 1) / 2) / F.col("n")).alias(out))
    return df.join(ranks, [*by, value], "left")


def percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per group, one column per point.

    Selection instead of sorting: bucket counts (combined map-side, tiny) tell
    which buckets hold the wanted positions, and only the rows of those
    buckets are counted by value and shuffled.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, value, order_bin(value).alias("_bin"))
    across = Window.partitionBy(*by)
    bins = (rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_size"))
            .withColumn("_before", F.sum("_size").over(across.orderBy("_bin")) - F.col("_size"))
            .withColumn("_n", F.sum("_size").over(across)))
    wanted = []
    for name, q in points.items():
        pos = (F.col("_n") - 1) * F.lit(q)
        wanted += [F.struct(F.lit(f"lo_{name}").alias("slot"), F.floor(pos).alias("at"), (pos - F.floor(pos)).alias("part")),
                   F.struct(F.lit(f"hi_{name}").alias("slot"), F.ceil(pos).alias("at"), (pos - F.floor(pos)).alias("part"))]
    hit = F.filter(F.array(*wanted), lambda s: (s["at"] >= F.col("_before")) & (s["at"] < F.col("_before") + F.col("_size")))
    # At most two buckets per point and group remain.
    chosen = bins.withColumn("_hit", hit).where(F.size("_hit") > 0).select(*by, "_bin", "_before", "_hit")
    counted = (rows.join(chosen.select(*by, "_bin"), [*by, "_bin"], "left_semi")
               .groupBy(*by, "_bin", value).agg(F.count(F.lit(1)).alias("_cnt")))
    inside = Window.partitionBy(*by, "_bin").orderBy(value)
    placed = counted.withColumn("_upto", F.sum("_cnt").over(inside)).join(chosen, [*by, "_bin"])
    first, end = F.col("_before") + F.col("_upto") - F.col("_cnt"), F.col("_before") + F.col("_upto")
    found = placed.withColumn("s", F.explode("_hit")).where((F.col("s.at") >= first) & (F.col("s.at") < end))
    wide = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("s.slot") == f"{side}_{name}", F.col(value))).alias(f"_{side}_{name}")
          for name in points for side in ("lo", "hi")],
        *[F.max(F.when(F.col("s.slot") == f"lo_{name}", F.col("s.part"))).alias(f"_part_{name}") for name in points])
    out = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in points]
    return wide.select(*by, *out)


def nearest_to_percentile(df: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """For each percentile, the key whose value lies closest (smallest key on ties).

    Distances that agree to a billionth of the target are a tie: a percentile halfway
    between two values is equally far from both, but for the rounding of its last digit.
    """
    marks = percentiles(df, [], value, points)
    marks = marks.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("point"), F.col(name).alias("target")) for name in points
    ])).alias("m")).select("m.*")
    # One row per requested point: the size is fixed by the caller's dict.
    pairs = df.select(key, value, F.explode(F.array(*[F.lit(n) for n in points])).alias("point"))
    gap = F.struct(F.round(F.abs(F.col(value) - F.col("target")) / F.greatest(F.abs("target"), F.lit(1e-300)), 9), F.col(key))
    return (pairs.join(F.broadcast(marks), "point").groupBy("point")
            .agg(F.min_by(F.struct(key, value), gap).alias("best"), F.first("target").alias("target"))
            .select("point", "target", f"best.{key}", f"best.{value}"))


def histogram(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts between the group's min and max; the max falls in the last bin."""
    if by:
        limits = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        joined = df.join(limits, by)
    else:
        limits = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
        joined = df.withColumn("_limits", limits).select(
            value, F.col("_limits.lo").alias("lo"), F.col("_limits.hi").alias("hi"))
    span = F.col("hi") - F.col("lo")
    slot = F.when(span > 0, F.least(F.floor((F.col(value) - F.col("lo")) / span * bins), F.lit(bins - 1)))
    return (joined.where(F.col(value).isNotNull())
            .groupBy(*by, F.coalesce(slot, F.lit(0)).cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))
