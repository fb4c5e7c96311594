"""First breach by blocks, as-of over segments, interval joins and committed state versions against plain loops."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.operators import asof, breach, snapshots
from tidemark.operators.asof import Stream
from tidemark.sources import sinks

D = dt.date


def walk(seed, n, start="2020-01-01"):
    """Closes with gaps in the calendar, ATR unknown at first, some closes missing."""
    rng = np.random.default_rng(seed)
    days = pd.date_range(start, periods=n * 2).date[np.sort(rng.choice(n * 2, n, replace=False))]
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), 2)
    atr = [None if k < 22 else float(rng.choice([0.5, 2.0, 4.0])) for k in range(n)]
    gone = set(rng.choice(n, n // 20, replace=False))
    return [(days[k], None if k in gone else float(close[k]), atr[k]) for k in range(n)]


def slow_stop(rows, entry, until, cfg):
    rows = [r for r in rows if r[1] is not None and r[0] >= entry and (until is None or r[0] <= until)]
    if not rows:
        return None
    peak, fixed, by_atr = 0.0, None, None
    for day, close, atr in rows:
        peak = max(peak, close)
        if fixed is None and close < peak * (1 - cfg.trailing_stop):
            fixed = day
        if by_atr is None and atr is not None and (day - entry).days >= cfg.stop_grace_days and close < peak - cfg.atr_multiple * atr:
            by_atr = day
    return fixed, by_atr, peak, rows[-1][0]


@pytest.mark.parametrize("block", [4, 64])
def test_first_breach_by_blocks_equals_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(breach, "BLOCK", block)
    panels = {f"t{k}": walk(k, 260) for k in range(6)}
    panels["rise"] = [(D(2020, 1, 1) + dt.timedelta(days=k), 10.0 + k, 1.0) for k in range(200)]
    bars = spark.createDataFrame([(t, *r) for t, rows in panels.items() for r in rows], "ticker string, date date, close double, atr double")
    rng = np.random.default_rng(9)
    pairs = {(t, rows[i][0] + dt.timedelta(days=int(rng.integers(-1, 2)))) for t, rows in panels.items() for i in rng.choice(len(rows), 25, replace=False)}
    pairs |= {("rise", D(2019, 1, 1)), ("rise", D(2030, 1, 1)), ("none", D(2020, 1, 1))}
    pairs = [(t, d, None if rng.random() < 0.5 else d + dt.timedelta(days=int(rng.integers(-2, 200)))) for t, d in sorted(pairs)]
    cfg = replace(DEFAULT, atr_multiple=2.0)
    got = {(r.ticker, r.entry_date): tuple(r)[2:] for r in breach.stop_days(
        spark.createDataFrame(pairs, "ticker string, entry_date date, until date"), bars, cfg).collect()}
    want = {(t, d): slow_stop(panels.get(t, []), d, u, cfg) for t, d, u in pairs}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert sum(v is not None and v[1] is not None for v in want.values()) > 20


def test_an_entry_opens_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(breach, "BLOCK", 8)
    rows = [("k", D(2010, 1, 1) + dt.timedelta(days=k), 100.0 + k % 3, 1.0) for k in range(2000)] + [("k", D(2016, 1, 1), 50.0, 1.0)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, atr double")
    blocked = breach.blocked(bars)
    pair = spark.createDataFrame([("k", D(2010, 2, 1), None)], "ticker string, entry_date date, until date")
    found = pair.join(breach.summaries(blocked), "ticker").withColumn("own", F.struct(F.lit(3).alias("block"), F.lit(102.0).alias("peak_on")))
    assert len(found.select(breach._opened(DEFAULT).alias("x")).first().x.open) <= 4
    got = breach.stop_days(pair, bars).first()
    assert (got.trailing_date, got.atr_date, got.peak_close) == (D(2016, 1, 1), D(2016, 1, 1), 102.0)


def test_segmented_asof_equals_the_plain_one_and_splits_a_hot_key(spark):
    rng = np.random.default_rng(2)
    n = 3000
    keys = ["hot" if rng.random() < 0.5 else f"k{rng.integers(9)}" for _ in range(n)]
    at = rng.integers(0, 10**6, n)
    at[:200] = 5  # a burst
    frame = spark.createDataFrame([(k, int(t), None if rng.random() < 0.3 else float(i), None if rng.random() < 0.6 else i)
                                   for i, (k, t) in enumerate(zip(keys, at))], "key string, t long, a double, b long").dropDuplicates(["key", "t"])
    probe = spark.createDataFrame([(f"k{rng.integers(12)}" if rng.random() < 0.5 else "hot", int(rng.integers(-10, 1_100_000)), i) for i in range(2000)]
                                  + [("hot", None, -1), (None, 7, -2), ("hot", 5, -3), ("hot", 5, -3)], "key string, at long, id long")
    streams = [Stream(frame, "t", ["a", "b"]), Stream(frame, "t", ["a", "b"], row=True, name="both")]
    order = lambda df: sorted(map(str, df.collect()))
    known = probe.where("at IS NOT NULL")
    plain = order(asof.asof_backward(known, "key", "at", streams))
    for blocks in (1, 7, 200):
        got = asof.asof_segmented(probe, "key", "at", streams, blocks)
        assert order(got.where("at IS NOT NULL")) == plain
        assert got.where("at IS NULL").select("id", "a", "b", "both").collect() == [(-1, None, None, None)]
        for strict in (True, False):
            plain_forward = order(asof.asof_forward(known, frame, "key", "at", "b", series_ts="t", strict=strict))
            assert order(asof.asof_segmented(known, "key", "at", [Stream(frame, "t", ["b"])], blocks, forward=True, strict=strict)) == plain_forward
    block = asof.time_blocks(frame, "t", 50)
    sizes = frame.where("key = 'hot'").groupBy(block(F.col("t").cast("double")).alias("b")).count().collect()
    assert len(sizes) > 40 and max(r["count"] for r in sizes) < 200
    assert asof.asof_segmented(probe.limit(0), "key", "at", streams).count() == 0


def test_segmented_asof_takes_dates_and_timestamps(spark):
    s = spark.createDataFrame([("k", D(2024, 1, d), dt.datetime(2024, 1, d, 12), d) for d in (2, 5, 9)], "key string, day date, at timestamp_ntz, v int")
    p = spark.createDataFrame([("k", D(2024, 1, d), dt.datetime(2024, 1, d, 11)) for d in range(1, 12)], "key string, pd date, pt timestamp_ntz")
    got = asof.asof_segmented(p, "key", "pd", [Stream(s, "day", ["v"])], 3)
    assert {r.pd.day: r.v for r in got.collect()} == {d: max((x for x in (2, 5, 9) if x <= d), default=None) for d in range(1, 12)}
    got = asof.asof_segmented(p, "key", "pt", [Stream(s, "at", ["v"])], 3)
    assert {r.pt.day: r.v for r in got.collect()} == {d: max((x for x in (2, 5, 9) if x < d), default=None) for d in range(1, 12)}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join_gives_each_pair_once(spark, width):
    rng = np.random.default_rng(3)
    spans = lambda n: [(f"k{rng.integers(3)}", i, int(a := rng.integers(-40, 60)), int(a + rng.integers(-1, 30))) for i in range(n)]
    left, right = spans(80) + [("k0", 80, None, 3)], spans(70) + [(None, 70, 0, 3)]
    a = spark.createDataFrame(left, "key string, l long, l0 long, l1 long")
    b = spark.createDataFrame(right, "key string, r long, r0 long, r1 long")
    got = asof.interval_join(a, b, "key", ("l0", "l1"), ("r0", "r1"), width)
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[0] and x[2] is not None and x[2] <= x[3] and y[2] <= y[3]
                  and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r.l, r.r) for r in got.collect()) == want and set(got.columns) == {"key", "l", "l0", "l1", "r", "r0", "r1"}


def test_interval_join_splits_a_key_by_time(spark):
    grid = spark.range(400).select(F.lit("hot").alias("key"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    per = grid.select("key", F.col("d").alias("p0"), F.date_add("d", 20).alias("p1"))
    plan = asof.interval_join(grid, per, "key", ("d", "d"), ("p0", "p1"), 30)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "_bucket" in plan
    assert asof.interval_join(grid, per, "key", ("d", "d"), ("p0", "p1"), 30).count() == sum(min(k, 20) + 1 for k in range(400))


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "state")
    frame = lambda v: spark.createDataFrame([("k", v)], "ticker string, score int")
    with pytest.raises(FileNotFoundError):
        sinks.read_state(spark, root)
    sinks.write_state(frame(1), root, 1)
    between = dt.datetime.now(dt.timezone.utc)
    frame(2).write.parquet(f"{root}/version=2/{'0' * 32}")  # written, not committed
    (tmp_path / "state" / "version=3" / "x" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "state" / "version=3" / "x" / "_temporary" / "0" / "part-0.parquet").write_bytes(b"half")
    assert sinks.read_state(spark, root).first().score == 1
    sinks.write_state(frame(20), root, 2)
    sinks.write_state(frame(10), root, 1)  # again: replaces the first
    assert [v.version for v in sinks.state_versions(spark, root)] == [1, 2]
    assert sinks.read_state(spark, root).first().score == 20 and sinks.read_state(spark, root, 1).first().score == 10
    with pytest.raises(FileNotFoundError):
        sinks.read_state(spark, root, as_of=between)
    assert sinks.read_state(spark, root, as_of=dt.datetime.now(dt.timezone.utc)).first().score == 20


def test_change_feed_reads_changed_parts_alone(spark, tmp_path):
    rng = np.random.default_rng(8)
    scans, level = {}, {f"t{k}": 5 for k in range(300)}
    for d in range(1, 7):
        for t in rng.choice(sorted(level), 4 if d != 4 else 0, replace=False):
            level[t] = int(rng.integers(5, 14))
        scans[D(2024, 1, d)] = {t: v for t, v in level.items() if not (d == 5 and t == "t1")}
    level["t1"] = 13
    rows = [(t, d, v) for d, some in scans.items() for t, v in some.items()]
    path = str(tmp_path / "scans")
    frame = spark.createDataFrame(rows, "ticker string, scan_date date, score long")
    for early in (F.col("scan_date") <= "2024-01-03", F.col("scan_date") > "2024-01-03"):
        snapshots.write_scans(frame.where(early), path, 32)
    want, before = set(), {}
    for d, some in scans.items():
        now = {t: v for t, v in some.items() if v >= 11}
        want |= {(t, d, "NEW", v, 0) for t, v in now.items() if t not in before}
        want |= {(t, d, "CHANGED", v, before[t]) for t, v in now.items() if t in before and before[t] != v}
        want |= {(t, d, "REMOVED", some.get(t), v) for t, v in before.items() if t not in now}
        before = now
    assert {tuple(r) for r in snapshots.change_feed(spark, path).collect()} == want and want
    parts = {(r.day, r.part) for r in snapshots.changed_parts(spark.read.parquet(f"{path}/digests")).collect()}
    assert not any(d == D(2024, 1, 4) for d, _ in parts) and len(parts) < 6 * 12
    # Parts that are equal to those of the day before and of the day after are never opened.
    after = {(d - dt.timedelta(days=1), p) for d, p in parts}
    for folder in (tmp_path / "scans" / "rows").glob("slot=*"):
        day, part = folder.name.split("=")[1].split("_")
        key = (D.fromisoformat(day), int(part))
        if key not in parts | after:
            for f in folder.glob("*"):
                f.write_bytes(b"unreadable")
    schema = spark.read.schema("ticker string, score long, slot string")
    assert {tuple(r) for r in snapshots.change_feed(spark, path, rows=schema.parquet(f"{path}/rows")).collect()} == want
