"""As-of and interval joins.

Spark has no public as-of join, so probes and series are stacked and the
latest value is carried along one window per key: a single shuffle, linear
work. Dates are calendar days and callers pass one row per key and day on
either side (``one_per_day`` makes a probe so), which bounds a window partition
by the length of the calendar however many raw rows a key has. Feeds without
that bound (ticks, a key with a third of all rows) take ``asof_segmented``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Stream:
    """One input of an as-of lookup.

    ``row=False``: every column keeps its own last non-null value.
    ``row=True``: the last row in which all of ``complete`` are known.
    """
    frame: DataFrame
    ts: str
    cols: list[str]
    row: bool = False
    name: str = "row"
    complete: list[str] | None = None

    def packed(self) -> tuple[DataFrame, list[str]]:
        if not self.row:
            return self.frame, self.cols
        need = self.cols if self.complete is None else self.complete
        rows = self.frame.dropna("any", subset=need) if need else self.frame
        return rows.withColumn(self.name, F.struct(*self.cols)), [self.name]


def _named(keys: list[str]) -> list[Column]:
    """The keys under names of their own: a union keeps the partitioning of bucketed
    inputs only where its columns are new on every side, free of table qualifiers."""
    return [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]


def _names(keys: list[str]) -> list[str]:
    return [f"_key{i}" for i in range(len(keys))]


def _stacked(probe: DataFrame, keys: list[str], ts: str, streams: list[Stream]) -> tuple[DataFrame, list[str]]:
    """Probes (side 1) and series (side 0) in one frame, and the columns to carry."""
    tagged = probe.select(*_named(keys), F.col(ts).alias("_ts"), F.lit(1).alias("_side"),
                          F.struct(*probe.columns).alias("_probe"))
    carried: list[str] = []
    for s in streams:
        frame, cols = s.packed()
        part = frame.select(*_named(keys), F.col(s.ts).alias("_ts"), F.lit(0).alias("_side"), *cols)
        tagged = tagged.unionByName(part, allowMissingColumns=True)
        carried += cols
    return tagged, carried


def asof_backward(probe: DataFrame, key: str | list[str], ts: str, streams: list[Stream]) -> DataFrame:
    """Adds to each probe row the latest stream values at or before ``ts``."""
    keys = [key] if isinstance(key, str) else key
    tagged, carried = _stacked(probe, keys, ts, streams)
    w = (Window.partitionBy(*_names(keys)).orderBy("_ts", "_side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (tagged.select("_side", "_probe", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in carried])
            .where(F.col("_side") == 1).select("_probe.*", *carried))


#: Time is cut into so many cells of equal length, which are counted and joined to blocks of about equal rows.
CELLS = 4096


def time_axis(df: DataFrame, ts: str) -> Column:
    """A date, timestamp or number as a double that grows with it."""
    kind = df.schema[ts].dataType.simpleString()
    if kind == "date":
        return F.unix_date(ts).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    return F.col(ts).cast("double")


def time_blocks(rows: DataFrame, ts: str, blocks: int) -> Callable[[Column], Column]:
    """A function of the time axis: the number of its block. The blocks are stretches of time with
    about equally many rows, whatever the keys; ``CELLS`` counts at most come to the driver."""
    axis = time_axis(rows, ts)
    lo, hi = rows.agg(F.min(axis), F.max(axis)).first()
    if lo is None or lo == hi:
        return lambda x: F.when(x.isNotNull(), 0)

    def cell(x: Column) -> Column:
        return F.when(x.isNotNull(), F.least(F.floor((x - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1))).cast("int")

    counts = {r.cell: r["count"] for r in rows.groupBy(cell(axis).alias("cell")).count().collect() if r.cell is not None}
    total, before, table = sum(counts.values()), 0, []
    for k in range(CELLS):
        table.append(before * blocks // total)
        before += counts.get(k, 0)
    return lambda x: F.get(F.lit(table), cell(x))


def asof_segmented(probe: DataFrame, key: str | list[str], ts: str, streams: list[Stream], blocks: int = 200,
                   forward: bool = False, strict: bool = True) -> DataFrame:
    """``asof_backward`` for keys of any size: a key's rows are split into blocks of time.

    A window runs per (key, block). What a block starts with comes from the blocks before it: their last
    values, one row per (key, block) from a map-side aggregation, are carried along a window of at most
    ``blocks`` rows per key, and join the block as a row that precedes it. A key with a third of all rows is
    thus spread over a third of ``blocks`` tasks' rows each. Inputs are read three times: pass staged tables.
    Rows without a time have no block and find nothing. ``forward`` looks the other way, for the first values
    after ``ts`` (at or after it when ``strict`` is false).
    """
    keys = [key] if isinstance(key, str) else key
    names = _names(keys)
    tagged, carried = _stacked(probe, keys, ts, streams)
    block = time_blocks(tagged, "_ts", blocks)
    rows = tagged.withColumn("_block", block(time_axis(tagged, "_ts")))
    nearest = F.min_by if forward else F.max_by
    ends = rows.where(F.col("_block").isNotNull()).groupBy(*names, "_block").agg(
        *[nearest(c, F.when(F.col(c).isNotNull(), F.col("_ts"))).alias(c) for c in carried])
    passed = Window.partitionBy(*names).orderBy(F.col("_block").desc() if forward else F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*names, "_block", F.lit(-1).alias("_side"), *[F.last(c, ignorenulls=True).over(passed).alias(c) for c in carried])
    time = F.col("_ts").desc_nulls_first() if forward else F.col("_ts").asc_nulls_first()
    # Of one time, series come before probes unless a probe must not see them.
    side = F.when(F.col("_side") < 0, -1).otherwise(1 - F.col("_side")) if forward and strict else F.col("_side")
    w = Window.partitionBy(*names, "_block").orderBy(time, side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.unionByName(starts, allowMissingColumns=True).select(
        "_side", "_probe", *[F.when(F.col("_block").isNotNull(), F.last(c, ignorenulls=True).over(w)).alias(c) for c in carried])
    return seen.where(F.col("_side") == 1).select("_probe.*", *carried)


def asof_backward_row(probe: DataFrame, series: DataFrame, key: str, ts: str, cols: list[str],
                      series_ts: str = "date") -> DataFrame:
    """As-of on the last row in which *every* column is known."""
    out = asof_backward(probe, key, ts, [Stream(series, series_ts, cols, row=True, name="_row")])
    return out.select(*probe.columns, *[F.col(f"_row.{c}").alias(c) for c in cols])


def asof_forward(probe: DataFrame, series: DataFrame, key: str | list[str], ts: str, col: str,
                 series_ts: str = "date", strict: bool = True) -> DataFrame:
    """First value after ``ts`` (at or after it when ``strict`` is false)."""
    keys = [key] if isinstance(key, str) else key
    tagged = probe.select(*_named(keys), F.col(ts).alias("_ts"), F.lit(0 if not strict else 1).alias("_side"),
                          F.lit(True).alias("_keep"), F.struct(*probe.columns).alias("_probe"))
    part = series.select(*_named(keys), F.col(series_ts).alias("_ts"), F.lit(0 if strict else 1).alias("_side"),
                         F.lit(False).alias("_keep"), col)
    # Backwards in time the frame grows, which Spark updates row by row; a frame that
    # shrinks towards the end it would aggregate anew for each row.
    w = (Window.partitionBy(*_names(keys)).orderBy(F.col("_ts").desc(), F.col("_side").desc())
         .rowsBetween(Window.unboundedPreceding, -1))
    return (tagged.unionByName(part, allowMissingColumns=True)
            .select("_keep", "_probe", F.last(col, ignorenulls=True).over(w).alias(col))
            .where("_keep").select("_probe.*", col))


def one_per_day(probe: DataFrame, key: str, ts: str) -> DataFrame:
    """Distinct (key, day) of a probe side of unknown multiplicity."""
    return probe.select(key, ts).distinct()


def interval_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str],
                  width: int) -> DataFrame:
    """Pairs of one key whose closed spans (days, dates or whole numbers) overlap; a point is a span of equal ends.

    A span is dealt to every bucket of ``width`` that it touches, and the sides meet by an equi-join on key and
    bucket, so a key with many rows is split by time and no pair is compared outside the buckets both touch. Of
    those buckets one owns the pair: that of the later start, so no pair comes twice. ``width`` near the usual
    length of a span keeps the copies few. Spans with a NULL end pair with nothing. Column names must differ but
    for ``key``.
    """
    def bucketed(df: DataFrame, span: tuple[str, str], start: str) -> DataFrame:
        def number(c: str) -> Column:
            return F.unix_date(c).cast("bigint") if df.schema[c].dataType.simpleString() == "date" else F.col(c).cast("bigint")

        lo, hi = (F.floor(number(c) / width) for c in span)
        some = df.where(F.col(span[0]) <= F.col(span[1]))
        return some.withColumn(start, lo).withColumn("_bucket", F.explode(F.sequence(lo, hi)))

    both = bucketed(left, left_span, "_from_l").join(bucketed(right, right_span, "_from_r"), [key, "_bucket"])
    meet = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    return both.where((F.col("_bucket") == F.greatest("_from_l", "_from_r")) & meet).drop("_bucket", "_from_l", "_from_r")


def available_periods(grid: DataFrame, periods: DataFrame, key: str, as_of: str, period_end: str,
                      lag: int, lookback: int | None = None, width: int = 184) -> DataFrame:
    """Periods published by ``as_of``, optionally only those of a look-back: an
    interval join of days with the spans in which a period counts. Without a
    look-back a span ends on the last day of the grid."""
    end = F.date_add("available", lookback) if lookback is not None else grid.agg(F.max(as_of)).scalar()
    p = periods.withColumn("available", F.date_add(period_end, lag)).withColumn("_until", end)
    return interval_join(grid, p, key, (as_of, as_of), ("available", "_until"), width).drop("_until")


def bars_since_entry(entries: DataFrame, bars: DataFrame, key: str, entry: str, until: Column,
                     cols: list[str]) -> DataFrame:
    """Bars of each entry's key from its entry day to ``until``. Callers pass
    one entry per (key, day); both sides are then bounded by the calendar."""
    b = bars.select(F.col(key).alias("_k"), F.col("date"), *cols)
    return (entries.join(b, (F.col(key) == F.col("_k")) & (F.col("date") >= F.col(entry))
                         & (F.col("date") <= until)).drop("_k"))


def align_to_calendar(series: DataFrame, calendar: DataFrame, key: str, value: str) -> DataFrame:
    """Every key on every calendar day, gaps filled forward; days before the
    first observation stay NULL. Keys are scenarios, so the result is
    scenarios times days."""
    span = calendar.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    days = (series.select(key).distinct().withColumn("_span", span)
            .select(key, F.explode(F.sequence("_span.lo", "_span.hi")).alias("date"))
            .join(calendar.select("date"), "date"))
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    seen = days.join(series.select(key, "date", value), [key, "date"], "left")
    return seen.select(key, "date", F.last(value, ignorenulls=True).over(w).alias(value))
