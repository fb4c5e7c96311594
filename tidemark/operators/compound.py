"""Ordered compounding over groups of any size.

An equity curve is a running product, its drawdown a running maximum. Both
are computed inside small ordered chunks first; one summary row per chunk is
then scanned and combined with the rows. A group with a third of all rows is
thereby spread over its chunks. ``chunk`` columns must sort like ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _locals(df: DataFrame, by: list[str], chunk: list[str], order: list[str], factor: Column) -> DataFrame:
    w = (Window.partitionBy(*by, *chunk).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.withColumn("_f", factor)
            .withColumn("_p", F.product("_f").over(w))
            .withColumn("_m", F.max("_p").over(w)))


def chunk_summaries(df: DataFrame, by: list[str], chunk: list[str], order: list[str], factor: Column,
                    *extra: Column) -> DataFrame:
    """Per chunk: its product, extreme prefixes and worst inner ratio, with any
    further aggregates of its rows."""
    return _locals(df, by, chunk, order, factor).groupBy(*by, *chunk).agg(
        F.product("_f").alias("_prod"), F.max("_p").alias("_hi"), F.min("_p").alias("_lo"),
        F.min(F.col("_p") / F.col("_m")).alias("_worst"), *extra)


def _placed(chunks: DataFrame, by: list[str], chunk: list[str]) -> DataFrame:
    """Adds the level at which each chunk starts and the peak before it."""
    before = Window.partitionBy(*by).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    start = chunks.withColumn("_start", F.coalesce(F.product("_prod").over(before), F.lit(1.0)))
    peak = F.max(F.col("_start") * F.col("_hi")).over(before)
    return start.withColumn("_peak", F.greatest(F.lit(1.0), F.coalesce(peak, F.lit(1.0))))


def compound_curve(df: DataFrame, by: list[str], chunk: list[str], order: list[str],
                   ret: Column, size: float, capital: float) -> DataFrame:
    """Rows with ``equity`` (capital compounded in order) and ``drawdown``."""
    factor = 1 + size * ret
    local = _locals(df, by, chunk, order, factor)
    start = _placed(chunk_summaries(df, by, chunk, order, factor), by, chunk).select(*by, *chunk, "_start", "_peak")
    rows = local.join(start, [*by, *chunk])
    level = F.col("_start") * F.col("_p")
    peak = F.greatest(F.col("_peak"), F.col("_start") * F.col("_m"))
    return rows.select(*df.columns, (level * capital).alias("equity"), (level / peak - 1).alias("drawdown"))


def combine_chunks(chunks: DataFrame, by: list[str], chunk: list[str], *extra: Column) -> DataFrame:
    """Per group: ``growth`` (final over initial) and ``max_drawdown`` from its
    chunk summaries, with any further aggregates of chunk columns."""
    worst = F.least(F.col("_worst"), F.col("_start") * F.col("_lo") / F.col("_peak"))
    return _placed(chunks, by, chunk).groupBy(*by).agg(
        F.product("_prod").alias("growth"), F.least(F.min(worst) - 1, F.lit(0.0)).alias("max_drawdown"), *extra)


def compound_stats(df: DataFrame, by: list[str], chunk: list[str], order: list[str],
                   ret: Column, size: float) -> DataFrame:
    """Per group: ``growth`` and ``max_drawdown`` of the ordered returns."""
    return combine_chunks(chunk_summaries(df, by, chunk, order, 1 + size * ret), by, chunk)


# ---- moments that merge across chunks -------------------------------------

def moments(r: Column, name: str) -> list[Column]:
    """Chunk aggregates of ``r``: count, mean, population variance, extremes."""
    return [F.count(r).alias(f"{name}_n"), F.avg(r).alias(f"{name}_mean"), F.var_pop(r).alias(f"{name}_var"),
            F.min(r).alias(f"{name}_min"), F.max(r).alias(f"{name}_max")]


def merged_moments(name: str) -> list[Column]:
    """Group aggregates over chunk moments: the sums needed by ``pooled``."""
    n, m, v = F.col(f"{name}_n"), F.col(f"{name}_mean"), F.col(f"{name}_var")
    return [F.sum(n).alias(f"{name}_n"), F.sum(n * m).alias(f"{name}_sum"), F.sum(n * (v + m * m)).alias(f"{name}_sq"),
            F.min(f"{name}_min").alias(f"{name}_min"), F.max(f"{name}_max").alias(f"{name}_max")]


def pooled(name: str) -> tuple[Column, Column]:
    """Mean and population deviation from merged moments; identical values
    deviate by exactly zero."""
    n = F.col(f"{name}_n")
    mean = F.col(f"{name}_sum") / n
    var = F.greatest(F.col(f"{name}_sq") / n - mean * mean, F.lit(0.0))
    same = F.col(f"{name}_min") == F.col(f"{name}_max")
    return mean, F.when(same, 0.0).otherwise(F.sqrt(var))
