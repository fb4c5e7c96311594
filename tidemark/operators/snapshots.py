"""Score snapshots: change detection, boards, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Settings


def snapshot_join(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Both sides of every ticker: ``score`` now, ``prev_score`` before."""
    return current.select("ticker", "score").join(
        previous.select("ticker", F.col("score").alias("prev_score")), "ticker", "full_outer")


def change_kind(score: Column, prev: Column, threshold: int) -> Column:
    """``prev`` is the last alerted score (0 or NULL when none)."""
    now = score >= threshold
    known = F.coalesce(prev, F.lit(0)) != 0
    return (F.when(now & ~known, "NEW").when(now & known & (score != prev), "CHANGED")
            .when(~F.coalesce(now, F.lit(False)) & prev.isNotNull(), "REMOVED"))


def detect_changes(current: DataFrame, state: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """NEW, CHANGED and REMOVED alerts of a scan against the alert state."""
    j = snapshot_join(current, state)
    kind = change_kind(F.col("score"), F.col("prev_score"), cfg.alert_score)
    return j.withColumn("change", kind).where(F.col("change").isNotNull()).select(
        "ticker", "change", "score", "prev_score")


def next_state(current: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return current.where(F.col("score") >= cfg.alert_score).select("ticker", "score")


def _scan_digests(scans: DataFrame, cfg: Settings) -> DataFrame:
    """Per scan day and part: how many alerted rows, and 128 bits over them in any order."""
    alerted = F.col("score") >= cfg.alert_score

    def folded(seed: int) -> Column:
        return F.bit_xor(F.when(alerted, F.xxhash64(F.lit(seed), F.col("ticker"), F.col("score").cast("bigint"))))

    return scans.groupBy("scan_date", "part").agg(
        F.count_if(alerted).alias("n"), F.coalesce(folded(1), F.lit(0)).alias("a"), F.coalesce(folded(2), F.lit(0)).alias("b"))


def _slot(day: str) -> Column:
    """Day and part as one partition column, so that a list of pairs prunes exactly these."""
    return F.concat_ws("_", F.col(day).cast("string"), F.col("part").cast("string"))


def write_scans(scans: DataFrame, path: str, parts: int = 64, cfg: Settings = DEFAULT) -> None:
    """Appends whole scans ``(ticker, scan_date, score)`` to a history that ``change_feed`` reads: rows by day
    and part of the tickers, and a small table of digests beside them, written after the rows they stand for."""
    rows = scans.select("ticker", "scan_date", "score", F.pmod(F.xxhash64("ticker"), F.lit(parts)).cast("int").alias("part"))
    placed = rows.select("ticker", "score", _slot("scan_date").alias("slot")).repartition("slot")
    placed.write.mode("append").partitionBy("slot").parquet(f"{path}/rows")
    _scan_digests(rows, cfg).write.mode("append").parquet(f"{path}/digests")


def changed_parts(digests: DataFrame) -> DataFrame:
    """``(day, before, part)`` where the alerted rows of a part differ from those of the scan before. The first
    scan has no scan before it: all its parts with alerts count."""
    days = digests.select("scan_date").distinct()
    w = Window.orderBy("scan_date")  # one row per scan day
    follow = days.select(F.col("scan_date").alias("day"), F.lag("scan_date").over(w).alias("before"))
    now = digests.select(F.col("scan_date").alias("day"), "part", F.struct("n", "a", "b").alias("now"))
    then = digests.join(follow, digests["scan_date"] == follow["before"]).select("day", "part", F.struct("n", "a", "b").alias("then"))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    both = now.join(then, ["day", "part"], "full").withColumns({"now": F.coalesce("now", none), "then": F.coalesce("then", none)})
    return both.where(F.col("now") != F.col("then")).join(follow, "day").select("day", "before", "part")


def change_feed(spark: SparkSession, path: str, cfg: Settings = DEFAULT, rows: DataFrame | None = None) -> DataFrame:
    """NEW, CHANGED and REMOVED alerts between all consecutive scans of a history of ``write_scans``.

    Days are compared by digests first. Only parts that differ are read, on the day and on the one before (the
    list of them prunes partitions), and joined by ticker. ``prev_score`` is 0 where nothing was alerted.
    ``rows`` may hold the history's rows as read with a schema that is known.
    """
    from tidemark.sources.sinks import stage

    rows = spark.read.parquet(f"{path}/rows") if rows is None else rows
    parts = stage(changed_parts(spark.read.parquet(f"{path}/digests")), "changed-parts")

    def side(day: str, name: str) -> DataFrame:
        # The comparison tells Spark that the list is selective, so that it prunes the scan by it; one row per day and part.
        keys = parts.where(F.col(day) >= F.lit("0001-01-01").cast("date")).select("day", _slot(day).alias("slot"))
        return rows.join(keys, "slot").select("day", "ticker", F.col("score").cast("bigint").alias(name))

    before = side("before", "prev_score").where(F.col("prev_score") >= cfg.alert_score)
    both = side("day", "score").join(before, ["day", "ticker"], "full")
    change = change_kind(F.col("score"), F.col("prev_score"), cfg.alert_score)
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select(
        "ticker", F.col("day").alias("date"), "change", "score", F.coalesce("prev_score", F.lit(0)).alias("prev_score"))


def mark_to_market(positions: DataFrame, latest: DataFrame) -> DataFrame:
    """Positions (ticker, shares, entry_price, stop_pct) at the latest price;
    money columns stay NULL for unusable entries."""
    j = positions.join(latest.select("ticker", "price"), "ticker")
    ok = (F.col("entry_price") > 0) & (F.col("shares") > 0)
    cost, value = F.col("entry_price") * F.col("shares"), F.col("price") * F.col("shares")
    return j.select(
        "ticker", "shares", "entry_price", "price",
        F.when(ok, cost).alias("cost"), F.when(ok, value).alias("value"), F.when(ok, value - cost).alias("pnl"),
        F.when(ok, (F.col("price") / F.col("entry_price") - 1) * 100).alias("pnl_pct"),
        F.when(ok, F.col("entry_price") * (1 - F.coalesce(F.col("stop_pct"), F.lit(15.0)) / 100)).alias("stop_price"))


def portfolio_totals(marked: DataFrame) -> DataFrame:
    t = marked.agg(F.count("cost").alias("positions"), F.sum("cost").alias("cost"),
                   F.sum("value").alias("value"), F.sum("pnl").alias("pnl"))
    return t.withColumn("pnl_pct", F.when(F.col("cost") > 0, F.col("pnl") / F.col("cost") * 100))


def sector_allocation(positions: DataFrame, universe: DataFrame, limit: float = 35.0) -> DataFrame:
    """Summed ``weight`` (percent) per sector and whether it exceeds the limit."""
    j = positions.join(universe.select("ticker", "sector"), "ticker", "left")
    return (j.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector"))
            .agg(F.sum("weight").alias("allocation"))
            .withColumn("status", F.when(F.col("allocation") > limit, "OVER").otherwise("OK")))


def insider_summary(purchases: DataFrame) -> DataFrame:
    return purchases.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
