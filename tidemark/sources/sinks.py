"""Writers. Result tables go out partitioned; state is written as versions that
a commit file makes visible, so a reader never sees a half-written snapshot."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local
    master, whose tasks run on this machine, may go without one; it gets a
    temporary folder that is deleted at exit."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def children(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of everything under a file or folder, by Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate result to the shared folder and reads it back.

    Results that several branches of a plan use (features, the quarterly
    panel) are computed once and survive lost executors; later scans prune
    columns and know their sizes.
    """
    path = new_path(df.sparkSession, f"stage-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str, key: str = "ticker", order: str = "date", placed: bool = False) -> DataFrame:
    """Writes a table that many plans read by ``key`` in buckets of that key, sorted.

    Windows, groupings and as-of passes by the key then start from the scan, without
    a shuffle of the stored side; there are as many buckets as shuffle partitions, so
    that fresh results meet them as they come. One task writes one bucket: one file
    each. The files lie in the shared folder; the catalog only holds the bucketing.
    ``placed`` says that all rows of a key are in one task already, as after a window
    by it, and spares the shuffle.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = f"tidemark_{re.sub('[^a-z]', '_', name)}_{uuid.uuid4().hex}"
    rows = df if placed else df.repartition(buckets, key)
    (rows.write.format("parquet").bucketBy(buckets, key).sortBy(*dict.fromkeys((key, order)))
     .option("path", new_path(spark, f"store-{name}")).saveAsTable(label))
    return spark.table(label)


def trade_log(trades: DataFrame) -> DataFrame:
    """The log's published form: rounded."""
    return trades.select(
        "ticker", "tier", "entry_date", F.round("entry_price", 4).alias("entry_price"), "exit_date",
        F.round("exit_price", 4).alias("exit_price"), F.round("return_pct", 2).alias("return_pct"),
        F.round("pnl_dollars", 2).alias("pnl_dollars"), "hold_days", "exit_reason")


def write_trade_log(trades: DataFrame, path: str, mode_name: str, fmt: str = "csv") -> None:
    """Sorted by entry date across files: a range partitioning, not one task."""
    out = trade_log(trades).orderBy("entry_date").withColumn("mode", F.lit(mode_name))
    writer = out.write.mode("overwrite").partitionBy("mode").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = metrics.write.mode("overwrite").partitionBy("mode").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_sim_stats(stats: DataFrame, path: str) -> None:
    stats.select("sim", "final_value", "cagr", "max_drawdown", "sharpe", "win_rate").write.mode("overwrite").parquet(path)


COMMIT = "version long, folder string, time timestamp"


def write_state(state: DataFrame, root: str, version: int) -> str:
    """A new version of a snapshot. The files go to a folder of their own, and
    the version exists once its commit file, written last by one rename, names
    that folder; a version that is written again replaces itself that way."""
    spark = state.sparkSession
    folder = f"version={version}/{uuid.uuid4().hex}"
    state.write.parquet(f"{root}/{folder}")
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"
    put_text(spark, f"{root}/commits/{version:012d}.json", json.dumps({"version": version, "folder": folder, "time": now}))
    return f"{root}/{folder}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, draft = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, at, overwrite)


def state_versions(spark: SparkSession, root: str) -> list:
    """(version, folder, time) of the committed versions, oldest first; one small file each."""
    files = [p for p, _, _ in children(spark, f"{root}/commits") if p.endswith(".json")]
    return sorted(spark.read.schema(COMMIT).json(files).collect()) if files else []


def read_state(spark: SparkSession, root: str, version: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """One committed version: the newest, the one asked for, or the newest that was
    committed by ``as_of`` (an aware time). Only that version's files are opened."""
    found = [v for v in state_versions(spark, root) if version is None or v.version == version]
    if as_of is not None:
        found = [v for v in found if v.time.astimezone(timezone.utc) <= as_of]
    if not found:
        raise FileNotFoundError(f"no committed version in {root}")
    return spark.read.parquet(f"{root}/{found[-1].folder}")


def append_scan(scan: DataFrame, path: str) -> None:
    """Scan history, partitioned by ``scan_date``; high scores are flagged."""
    (scan.withColumn("alert", F.col("score") >= 11)
     .write.mode("append").partitionBy("scan_date").parquet(path))
