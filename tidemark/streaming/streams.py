"""Streaming twins: alert state, incremental scans, daily bars from ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.config import DEFAULT, Settings
from tidemark.operators.snapshots import change_kind
from tidemark.sources.sinks import children, new_path


def event_time(ts: str):
    """A zone-less timestamp as an instant counted from the epoch, so day
    windows line up with its dates in any session time zone."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
    return F.timestamp_micros(micros)


def event_date(instant):
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / 86_400_000_000).cast("int"))


def bars_from_ticks(ticks: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Event-time daily OHLCV per key from ``(key, ts, value)``. Partial
    aggregation runs before the shuffle; late ticks are dropped."""
    t = ticks.withColumn("_at", event_time("ts")).withWatermark("_at", watermark)
    order = F.struct("_at", "value")
    return t.groupBy(F.window("_at", "1 day").alias("w"), "key").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume")
    ).select("key", event_date(F.col("w.start")).alias("date"), "open", "high", "low", "close", "volume")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drains the available input into a Parquet table in the shared folder."""
    spark = stream.sparkSession
    root = new_path(spark, name)
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/data")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def run_batches(stream: DataFrame, name: str, step: Callable[[DataFrame, int, str], None], root: str | None = None) -> str:
    """Drains the input through ``step(batch, id, folder)``; returns the folder.
    Steps write per-batch directories, so a repeated batch replaces itself.
    With a ``root`` that is kept, the next run goes on where this one ended."""
    root = root or new_path(stream.sparkSession, name)
    q = (stream.writeStream.foreachBatch(lambda df, i: step(df, i, root))
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return root


@contextmanager
def rocksdb(spark: SparkSession):
    """State stores of streams that start inside keep their keys in RocksDB, not on the heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


MOVES = "day date, score bigint, prev_day date, prev_level bigint"


def alert_moves(updates: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``(ticker, day, score, prev_day, prev_level)``: each scan row next to what its ticker's last scan row left
    alerted, from keyed state; and a row without ``day`` for an alerted ticker that later scans lack.

    A ticker has state only while it is alerted, its level and day, and only tickers of the batch touch theirs. The
    watermark is the end of a scan: once a later day has been seen, the timer of a ticker that was not in it runs out.
    """
    kind = updates.schema["ticker"].dataType.simpleString()

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["ticker", "day", "score", "prev_day", "prev_level"]
        prev_day, level = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], None, None, prev_day, level)], columns=names)
            return
        scores = pd.concat(parts).groupby("date").score.max()
        out = []
        for day, score in scores.sort_index().items():
            known = score == score and score is not None
            out.append((key[0], day, int(score) if known else None, prev_day if level else None, level))
            prev_day, level = day, int(score) if known and score >= cfg.alert_score else 0
        if level:
            state.update((prev_day, level))
            state.setTimeoutTimestamp(int(datetime(prev_day.year, prev_day.month, prev_day.day, tzinfo=timezone.utc).timestamp() * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names).astype({"score": "Int64"})

    rows = updates.withColumn("_at", F.timestamp_seconds(F.unix_date("date").cast("bigint") * 86_400)).withWatermark("_at", "0 seconds")
    return rows.groupBy("ticker").applyInPandasWithState(update, f"ticker {kind}, {MOVES}", "day date, level long", "append", GroupStateTimeout.EventTimeTimeout)


def alert_step(cfg: Settings = DEFAULT) -> Callable[[DataFrame, int, str], None]:
    """Alerts of the moves of a batch. The only table kept beside the keyed state is the calendar of scan days: what
    was alerted on a day counts against the next scan alone, so a ticker that the next scan lacks is REMOVED on that
    day, with a NULL score, and NEW when it comes back."""
    def step(batch: DataFrame, batch_id: int, root: str) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/moves/batch={batch_id}")
        moves = spark.read.schema(batch.schema).parquet(f"{root}/moves/batch={batch_id}")
        moves.select("day").where(F.col("day").isNotNull()).distinct().write.mode("overwrite").parquet(f"{root}/days/batch={batch_id}")
        days = spark.read.schema("day date").parquet(f"{root}/days").distinct()
        w = Window.orderBy("day")  # one row per scan day
        following = days.select(F.col("day").alias("prev_day"), F.lead("day").over(w).alias("due"))
        seen = moves.join(following, "prev_day", "left")
        met = F.coalesce(F.col("due") == F.col("day"), F.lit(False))
        before = F.when(met, F.col("prev_level")).otherwise(F.lit(0).cast("bigint"))
        kind = change_kind(F.col("score"), F.when(before > 0, before), cfg.alert_score)
        changed = seen.where(F.col("day").isNotNull()).select("ticker", F.col("day").alias("date"), kind.alias("change"), "score", before.alias("prev_score"))
        gone = seen.where((F.col("prev_level") > 0) & ~met & F.col("due").isNotNull()).select(
            "ticker", F.col("due").alias("date"), F.lit("REMOVED").alias("change"), F.lit(None).cast("bigint").alias("score"), F.col("prev_level").alias("prev_score"))
        changed.where(F.col("change").isNotNull()).unionByName(gone).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
    return step


def stream_alerts(updates: DataFrame, cfg: Settings = DEFAULT, root: str | None = None) -> DataFrame:
    """All alerts so far of scans ``(ticker, date, score)``. ``root`` keeps checkpoint, state and alerts between runs.

    All rows of a date are one complete scan and arrive in one batch; scans arrive in order of their days.
    """
    spark = updates.sparkSession
    root = root or new_path(spark, "alerts")
    with rocksdb(spark):
        run_batches(alert_moves(updates, cfg), "alerts", alert_step(cfg), root)
    return spark.read.parquet(f"{root}/out").drop("batch")


def stream_scan(bars: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Incremental scan: each batch's new (ticker, date) pairs go through
    ``scan``; only they are evaluated."""
    def step(batch: DataFrame, batch_id: int, root: str) -> None:
        probe = batch.select("ticker", "date").distinct()
        scan(probe).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
    root = run_batches(bars, "scan", step)
    return bars.sparkSession.read.parquet(f"{root}/out").drop("batch")


def read_stream(spark: SparkSession, path: str, table: str, files_per_batch: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, whether it is one file or a folder
    of part files; the schema comes from the files."""
    at = f"{path}/{table}.parquet"
    files = [p for p, _, _ in children(spark, at)]
    if not files:
        raise FileNotFoundError(at)
    stream = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", files_per_batch)
    if any(p.rstrip("/").endswith(f"/{table}.parquet") for p in files):
        return stream.option("pathGlobFilter", f"{table}.parquet").parquet(path)
    return stream.parquet(at)
