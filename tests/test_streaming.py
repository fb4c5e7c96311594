import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import streams

D = dt.date


def feed(spark, path, batches, schema):
    """One file per batch, oldest first."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_alerts_keep_state_between_batches(spark, tmp_path):
    schema = "ticker long, date date, score long"
    batches = [[(1, D(2024, 1, 1), 11), (2, D(2024, 1, 1), 5), (3, D(2024, 1, 1), 12)],
               [(1, D(2024, 1, 2), 12), (2, D(2024, 1, 2), 11)],
               [(1, D(2024, 1, 3), 4), (2, D(2024, 1, 3), 11), (3, D(2024, 1, 3), 12)]]
    # ticker 3 is absent from the second scan
    got = streams.stream_alerts(feed(spark, str(tmp_path / "in"), batches, schema))
    rows = {(r.ticker, r.date.day, r.change, r.score, r.prev_score) for r in got.collect()}
    assert rows == {(1, 1, "NEW", 11, 0), (3, 1, "NEW", 12, 0), (1, 2, "CHANGED", 12, 11), (2, 2, "NEW", 11, 0),
                    (3, 2, "REMOVED", None, 12), (3, 3, "NEW", 12, 0), (1, 3, "REMOVED", 4, 12)}


def test_alerts_go_on_after_a_restart_and_take_any_ticker(spark, tmp_path):
    schema, root = "ticker string, date date, score long", str(tmp_path / "root")

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        return streams.stream_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), root=root)

    first = run([("A", D(2024, 1, 1), 12), ("B", D(2024, 1, 1), 11), ("B", D(2024, 1, 2), 11), ("C", D(2024, 1, 3), 11)])
    rows = {(r.ticker, r.date.day, r.change) for r in first.collect()}
    assert rows == {("A", 1, "NEW"), ("B", 1, "NEW"), ("A", 2, "REMOVED"), ("B", 3, "REMOVED"), ("C", 3, "NEW")}
    assert streams.stream_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), root=root).count() == 5
    again = {(r.ticker, r.date.day, r.change) for r in run([("D", D(2024, 1, 4), 11)]).collect()} - rows
    assert again == {("C", 4, "REMOVED"), ("D", 4, "NEW")}


def test_alerts_equal_a_walk_over_scans_and_state_holds_alerted_tickers(spark, tmp_path):
    rng, schema, root, source = random.Random(3), "ticker string, date date, score long", str(tmp_path / "root"), str(tmp_path / "in")
    days = [D(2024, 1, 1) + dt.timedelta(days=k + k // 3) for k in range(9)]
    scans = {d: {f"t{k}": rng.choice([None, 5, 10, 11, 12, 13]) for k in range(25) if rng.random() < 0.7} for d in days}
    scans[days[4]] = {"t1": 3}  # a scan without any alert
    want, before = set(), {}
    for d, some in scans.items():
        now = {t: v for t, v in some.items() if v is not None and v >= 11}
        want |= {(t, d, "NEW", v, 0) for t, v in now.items() if t not in before}
        want |= {(t, d, "CHANGED", v, before[t]) for t, v in now.items() if t in before and before[t] != v}
        want |= {(t, d, "REMOVED", some.get(t), v) for t, v in before.items() if t not in now}
        before = now
    for some in (days[:1], days[1:4], days[4:5], days[5:6], days[6:]):  # runs of their own, of one scan or several
        rows = [(t, d, v) for d in some for t, v in scans[d].items()]
        spark.createDataFrame(rows + rows[:2], schema).write.mode("append").parquet(source)
        out = streams.stream_alerts(spark.readStream.schema(schema).parquet(source), root=root)
    assert {tuple(r) for r in out.select("ticker", "date", "change", "score", "prev_score").collect()} == want and out.count() == len(want)
    kept = spark.read.format("statestore").load(f"{root}/checkpoint")
    assert {r.key[0] for r in kept.select("key").collect()} == set(before)


def test_a_table_streams_from_a_file_and_from_a_folder(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1 + k % 5), 1.0) for k in range(50)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double")
    df.repartition(3).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "tmp"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "tmp").glob("part-*.parquet")).rename(tmp_path / "file" / "events.parquet")
    for kind in ("folder", "file"):
        stream = streams.read_stream(spark, str(tmp_path / kind), "events")
        assert streams.run_to_table(stream, kind).count() == 50
    with pytest.raises(FileNotFoundError):
        streams.read_stream(spark, str(tmp_path), "events")


def test_late_ticks_are_dropped_and_closed_days_match_batch(spark, tmp_path):
    schema = "key long, ts timestamp_ntz, value double"
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    batches = [[(1, t(1, 1), 5.0), (1, t(1, 20), 7.0), (1, t(1, 9), 2.0)], [(1, t(5, 1), 1.0)], [(1, t(6, 1), 1.0)],
               [(1, t(1, 23), 99.0)], [(1, t(9, 1), 1.0)]]
    s = feed(spark, str(tmp_path / "in"), batches, schema)
    got = {r.date.day: (r.open, r.high, r.low, r.close, r.volume) for r in streams.run_to_table(streams.bars_from_ticks(s), "t").collect()}
    assert got[1] == (5.0, 7.0, 2.0, 7.0, 3)  # the tick of batch 4 came too late


def test_scan_sees_only_new_rows(spark, tmp_path):
    schema = "ticker long, date date"
    s = feed(spark, str(tmp_path / "in"), [[(1, D(2024, 1, 1))], [(1, D(2024, 1, 2)), (2, D(2024, 1, 2))]], schema)
    sizes = []

    def scan(probe):
        sizes.append(probe.count())
        return probe.withColumn("n", F.lit(sizes[-1]))

    got = streams.stream_scan(s, scan)
    assert sorted(sizes) == [1, 2] and got.count() == 3
