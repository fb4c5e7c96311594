"""Bootstrap of trade returns.

The trade number of every draw comes from an md5 of (simulation, draw, seed), made on
the executors, so results do not depend on parallelism. Blocks of draws are folded to
summaries, by groups of blocks that each meet the trade list, a copy of it per group;
with a list too long for a task, draws are rows that meet the trades by an equi-join.
Neither a path nor the trade list passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings
from tidemark.operators.compound import chunk_summaries, combine_chunks, compound_curve, moments, pooled
from tidemark.operators.ranks import histogram, nearest_to_percentile, percentiles

CHUNK_DRAWS = 16_384
#: Draws per task, about; longest trade list that is broadcast to draws (its size is counted first).
TASK_DRAWS, BROADCAST_TRADES = 2_000_000, 100_000
#: Longest trade list that a task holds (128 MB), trades per piece in which it travels, most copies of it.
LISTED_TRADES, PIECE_TRADES, MOST_GROUPS = 16_000_000, 65_536, 96


def numbered(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Dense ``idx`` from 0 by ``keys``. Positions are counted inside buckets of
    the leading key and shifted by the bucket totals: no global sort."""
    t = trades.withColumn("_b", F.year(keys[0]) * 12 + F.month(keys[0])).withColumn("_h", F.substring(
        F.md5(F.col(keys[1]).cast("string")), 1, 2))
    inside = Window.partitionBy("_b", "_h").orderBy(*keys)
    sizes = t.groupBy("_b", "_h").agg(F.count(F.lit(1)).alias("_n"))
    # At most months x 256 bucket rows, whatever the size of the log.
    shift = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b", "_h")) - F.col("_n"))
    return (t.withColumn("_rn", F.row_number().over(inside)).join(shift, ["_b", "_h"])
            .withColumn("idx", (F.col("_before") + F.col("_rn") - 1).cast("bigint"))
            .drop("_b", "_h", "_n", "_before", "_rn"))


def _number(sim: Column, draw: Column, seed: int, n: Column) -> Column:
    """Trade number of a draw. Never NULL: otherwise Spark hashes every draw a second time in a null filter."""
    text = F.concat_ws("-", sim.cast("string"), draw.cast("string"), F.lit(str(seed)))
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n, F.lit(0))


def _blocks(sims: DataFrame, n: int) -> DataFrame:
    """``(sim, block, _n, _low, _high)``: stretches of ``CHUNK_DRAWS`` draws, spread over tasks."""
    spark = sims.sparkSession
    # The block rows are few but grow a thousandfold, so their partitions are fixed by
    # number: adaptive execution would coalesce them into one task.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sims.count() * n // TASK_DRAWS))
    low = F.col("block") * CHUNK_DRAWS
    return (sims.withColumn("_n", F.lit(n).cast("bigint")).where(F.col("_n") > 0)
            .select("sim", "_n", F.explode(F.sequence(
                F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / CHUNK_DRAWS).cast("bigint"))).alias("block"))
            .repartition(parts, "sim", "block")
            .select("sim", "block", "_n", low.alias("_low"), (F.least(low + CHUNK_DRAWS, F.col("_n")) - 1).alias("_high")))


def draws(returns: DataFrame, sims: DataFrame | int, seed: int = 42) -> DataFrame:
    """``(sim, block, draw, return_dec)``: as many draws with replacement per
    simulation (a number of them, or a frame of ``sim``) as there are rows in
    ``returns`` (idx, return_dec)."""
    if isinstance(sims, int):
        sims = returns.sparkSession.range(sims).withColumnRenamed("id", "sim")
    n = returns.count()
    rows = _blocks(sims.select("sim"), n).select("sim", "block", "_n", F.explode(F.sequence("_low", "_high")).alias("draw"))
    idx = _number(F.col("sim"), F.col("draw"), seed, F.col("_n"))
    # Draws come from two explodes, whose size Spark cannot foresee: left alone
    # it would broadcast them. A short list goes to the draws; with a long one
    # both sides are shuffled by the (uniform) number.
    listed = F.broadcast(returns) if n <= BROADCAST_TRADES else returns.hint("shuffle_hash")
    return rows.select("sim", "block", "draw", idx.alias("idx")).join(listed, "idx")


def _hashes(seed: int) -> Callable:
    """Function of (sim, first draw, last draw): the first 32 bits of md5("sim-draw-seed") of all these draws at
    once, a numpy operation per step of MD5. Texts have one block of 55 bytes at most: 64-bit numbers and a seed of
    14 digits. Like everything a task calls here it is sent by value; executors need no copy of this package."""
    start = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
    add = [int(abs(math.sin(k + 1)) * 2 ** 32) for k in range(64)]
    turn = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
    place = [(k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16 for k in range(64)]

    def digest(words: list, n: int):
        import numpy as np

        a, b, c, d = (np.full(n, x, np.uint32) for x in start)
        f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for k in range(64):
            if k < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif k < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif k < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            a += f
            a += words[place[k]]
            a += np.uint32(add[k])
            left = turn[k // 16][k % 4]
            np.left_shift(a, np.uint32(left), out=g)
            a >>= np.uint32(32 - left)
            a |= g
            a += b
            a, d, c, b = d, c, b, a
        return (a + np.uint32(start[0])).byteswap()

    def hashes(sim: int, low: int, high: int):
        import numpy as np

        out = []
        while low <= high:  # one stretch per number of digits: the draws' texts differ in their digits alone
            digits = len(str(low))
            last = min(high, 10 ** digits - 1)
            head, tail = f"{sim}-".encode(), f"-{seed}".encode() + b"\x80"
            length = len(head) + digits + len(tail) - 1
            block = (head + bytes(digits) + tail).ljust(56, b"\0") + (8 * length).to_bytes(8, "little")
            words = [np.uint32(int.from_bytes(block[k:k + 4], "little")) for k in range(0, 64, 4)]
            rest = np.arange(low, last + 1, dtype=np.uint32)
            for at in reversed(range(len(head), len(head) + digits)):
                more = rest // np.uint32(10)
                words[at // 4] = words[at // 4] + ((rest - more * np.uint32(10) + np.uint32(48)) << np.uint32(8 * (at % 4)))
                rest = more
            out.append(digest(words, last + 1 - low))
            low = last + 1
        return np.concatenate(out)

    return hashes


FOLDED = "sim long, block long, _prod double, _hi double, _lo double, _worst double, r_n long, r_sum double, r_sq double, r_min double, r_max double, won long"


def _fold(size: float, seed: int) -> Callable:
    """Function of (a group's blocks, the trade list in pieces): a summary per block. NaN counts as the largest
    number, as in Spark's own extremes."""
    hashes, names, kinds = _hashes(seed), *zip(*(c.split() for c in FOLDED.split(", ")))

    def fold(blocks, pieces):
        import numpy as np
        import pyarrow as pa

        ordered = pieces.sort_by("piece").column("rs").combine_chunks()
        returns = ordered.flatten().to_numpy(zero_copy_only=False)
        out = []
        for sim, block, low, high in zip(*(blocks.column(c).to_pylist() for c in ("sim", "block", "_low", "_high"))):
            r = returns[hashes(sim, low, high) % np.uint32(len(returns))]
            x = r * size
            p = np.cumprod(1 + x)
            hi = np.maximum.accumulate(p)
            out.append((sim, block, p[-1], hi[-1], np.fmin.reduce(p), np.fmin.reduce(p / hi), len(r), x.sum(), (x * x).sum(),
                        np.fmin.reduce(x), x.max(), int(np.count_nonzero((r > 0) | np.isnan(r)))))
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(names), (pa.int64() if k == "long" else pa.float64() for k in kinds))], names=list(names))

    return fold


def _folded_blocks(returns: DataFrame, sims: DataFrame, n: int, seed: int, size: float) -> DataFrame:
    """Summary of each block of draws by one fold over its numbers: no row per draw, no join, no sort. Blocks are
    spread over groups; the trade list (``LISTED_TRADES`` at most) goes to each of them in pieces, so what is shuffled
    grows with the list and not with the draws."""
    rows = _blocks(sims, n)
    groups = min(MOST_GROUPS, max(1, -(-sims.count() * n // TASK_DRAWS)))
    piece = (returns.groupBy(F.floor(F.col("idx") / PIECE_TRADES).cast("long").alias("piece"))
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "return_dec"))), lambda x: x["return_dec"]).alias("rs")))
    # As many partitions as groups, by number: adaptive execution would coalesce the few block rows into one task.
    copies = piece.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g")
    placed = rows.withColumn("g", F.pmod(F.xxhash64("sim", "block"), F.lit(groups)).cast("int")).repartition(groups, "g")
    return placed.select("g", "sim", "block", "_low", "_high").groupBy("g").cogroup(copies.groupBy("g")).applyInArrow(_fold(size, seed), FOLDED)


def _joined_blocks(returns: DataFrame, sims: DataFrame, seed: int, size: float) -> DataFrame:
    """The same for trade lists of any length, from a row per draw."""
    r = F.col("return_dec")
    rows = chunk_summaries(draws(returns, sims, seed), ["sim"], ["block"], ["draw"], 1 + size * r, *moments(r * size, "r"), F.count_if(r > 0).alias("won"))
    return rows.withColumns({"r_sum": F.col("r_n") * F.col("r_mean"), "r_sq": F.col("r_n") * (F.col("r_var") + F.col("r_mean") * F.col("r_mean"))})


def simulate(returns: DataFrame, sims: int | None = None, years: float = 5.0, seed: int = 42,
             cfg: Settings = DEFAULT) -> DataFrame:
    """Final value, CAGR, drawdown, Sharpe ratio and win rate per simulation."""
    size, n = cfg.position_size, returns.count()
    numbers = returns.sparkSession.range(cfg.simulations if sims is None else sims).withColumnRenamed("id", "sim")
    blocks = _folded_blocks(returns, numbers, n, seed, size) if n <= LISTED_TRADES else _joined_blocks(returns, numbers, seed, size)
    path = combine_chunks(blocks, ["sim"], ["block"], F.sum("r_n").alias("r_n"), F.sum("r_sum").alias("r_sum"), F.sum("r_sq").alias("r_sq"),
                          F.min("r_min").alias("r_min"), F.max("r_max").alias("r_max"), F.sum("won").alias("_won"))
    mean, sd = pooled("r")
    path = (path.withColumn("_mean", mean).withColumn("_sd", sd).withColumn("_n", F.col("r_n"))
            .withColumn("win_rate", F.col("_won") / F.col("r_n")))
    sharpe = F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * F.sqrt(F.col("_n") / years)).otherwise(0.0)
    return path.select(
        "sim", (F.col("growth") * cfg.capital).alias("final_value"),
        (F.pow("growth", F.lit(1 / years)) - 1).alias("cagr"), "max_drawdown",
        sharpe.alias("sharpe"), "win_rate")


def drawn_paths(returns: DataFrame, chosen: DataFrame, seed: int = 42, cfg: Settings = DEFAULT) -> DataFrame:
    """Equity and drawdown after every draw of the chosen simulations (a frame with ``sim``), which are drawn
    again from their seeds, alone: nothing of the other paths is kept or computed."""
    rows = draws(returns, chosen.select("sim").distinct(), seed)
    curve = compound_curve(rows, ["sim"], ["block"], ["draw"], F.col("return_dec"), cfg.position_size, cfg.capital)
    return chosen.join(curve.select("sim", "draw", "equity", "drawdown"), "sim")


OUTCOMES = ["final_value", "cagr", "max_drawdown", "sharpe"]
POINTS = {"p5": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


def outcome_percentiles(stats: DataFrame) -> DataFrame:
    long = stats.unpivot(["sim"], OUTCOMES, "metric", "v")
    means = long.groupBy("metric").agg(F.avg("v").alias("mean"))
    return percentiles(long, ["metric"], "v", POINTS).join(means, "metric")


def outcome_probabilities(stats: DataFrame, cfg: Settings = DEFAULT, benchmark: float = 0.13) -> DataFrame:
    def share(cond):
        return F.avg(cond.cast("double"))
    v, c = F.col("final_value"), F.col("cagr")
    return stats.agg(
        share(v > cfg.capital).alias("p_profit"), share(c > benchmark).alias("p_beat_benchmark"),
        share(c > 0.10).alias("p_over_10"), share(c > 0.05).alias("p_over_5"),
        share(v < cfg.capital).alias("p_loss"), share(F.col("max_drawdown") < -0.30).alias("p_deep_drawdown"))


def outcome_histograms(stats: DataFrame, bins: int = 80) -> DataFrame:
    """``(metric, bin, n)`` of every outcome."""
    return histogram(stats.unpivot(["sim"], OUTCOMES, "metric", "v"), ["metric"], "v", bins)


def representative_paths(stats: DataFrame) -> DataFrame:
    return nearest_to_percentile(stats, "sim", "final_value", POINTS)
