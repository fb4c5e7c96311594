"""Shards along a Hilbert curve over several metadata dimensions. DataFrame functions only.

Every dimension is quantised to ``BITS`` bits (numbers by their quantiles, ids by their place between the
smallest and the largest, categories by hash). Rows are sorted by the index of their cell on the Hilbert
curve, which keeps cells that are near on the curve near in all dimensions; the sorted run is cut into shards
whose row counts differ by one at most. Shards, and runs of rows inside them, so cover small boxes, and
``manifest`` with ``prune`` skips those that a filter cannot meet, whatever dimension it names.

The sort is one range shuffle by (index, hash of the id, id, ...): rows of one cell are dealt by hash, so a
cell that holds a third of all rows is cut like any other. Places come from the sorted partitions' sizes;
no task sees more than its own range.

Defined results: a null value has cell 0 in its dimension; a null text counts as empty; repeated rows are
kept, their order among themselves does not show; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, stage

BITS, SHARDS = 8, 24
CELLS = 1 << BITS
#: Rows of a run that gets its own entry in the manifest.
RUN_ROWS = 65_536


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index of a cell on the Hilbert curve; ``axes`` are integers of ``bits`` bits."""
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        """Undoes the rotation or reflection that bit q of axis i stands for."""
        x0, xi, below = F.get(x, F.lit(0)), F.get(x, s["i"]), s["q"] - 1
        swap = x0.bitwiseXOR(xi).bitwiseAND(below)
        flip = xi.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, k: F.when(flip, F.when(k == 0, v.bitwiseXOR(below)).otherwise(v))
                           .when((k == 0) | (k == s["i"]), v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), turn)

    def gray(x: Column) -> Column:
        y = [F.get(x, F.lit(0))]
        for i in range(1, n):
            y.append(y[-1].bitwiseXOR(F.get(x, F.lit(i))))
        return F.array(*y)

    def flipped(y: Column) -> Column:
        last = F.get(y, F.lit(n - 1))
        low = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(last.bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(0) for b in range(bits - 1, 0, -1)])
        return let(low, lambda t: F.transform(y, lambda v: v.bitwiseXOR(t)))

    def woven(z: Column) -> Column:
        return reduce(lambda a, b: a + b, [
            F.shiftleft(F.shiftright(F.get(z, F.lit(i)), b).bitwiseAND(1).cast("long"), b * n + n - 1 - i) for b in range(bits) for i in range(n)])

    return let(let(let(turned, gray), flipped), woven)


def quantile_cells(df: DataFrame, column: str) -> Column:
    """A number's cell by its quantile; bounds come from one approximate pass over all rows."""
    bounds = df.agg(F.percentile_approx(column, [k / CELLS for k in range(1, CELLS)], 10_000).alias("b")).first().b or []
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.lit(bounds), lambda b: b < F.col(column))), F.lit(0))


def linear_cells(df: DataFrame, column: str) -> Column:
    """An id's cell by its place between the smallest and the largest."""
    a, b = df.agg(F.min(column), F.max(column)).first()
    if a is None:
        return F.lit(0)
    width = float(b) - float(a) + 1.0
    return F.coalesce(F.least(F.floor((F.col(column).cast("double") - float(a)) / width * CELLS), F.lit(CELLS - 1)), F.lit(0)).cast("int")


def hashed_cells(column: str) -> Column:
    """A category's cell by hash; null is cell 0."""
    return F.coalesce(F.crc32(F.col(column).cast("binary")) % (CELLS - 1) + 1, F.lit(0)).cast("int")


def assign(df: DataFrame, axes: list[Column], key: str, shards: int = SHARDS) -> DataFrame:
    """``df`` with ``curve``, ``shard`` and ``slot`` (place in the shard, from 0)."""
    names = df.columns
    row = F.struct(*[F.col(c) for c in names])
    keyed = df.select(row.alias("row"), hilbert_index(axes).alias("curve"), F.xxhash64(key).alias("tie"), F.col(key).alias("key"), F.hash(*names).alias("rest"))
    order = ["curve", "tie", "key", "rest"]
    # each range is sorted as it is written; the generated id holds the range and the place in it
    run = stage(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                .select("row", "curve", F.monotonically_increasing_id().alias("at")), "curve")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = run.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # a row per range, as many as shuffle partitions
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = run.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + place)
    shard = F.expr(f"(rank * {shards}L) div total").cast("int")
    first = F.expr(f"((shard * total) + {shards - 1}L) div {shards}L")
    return at.withColumn("shard", shard).select(*[F.col("row").getField(c).alias(c) for c in names], "curve", "shard", (F.col("rank") - first).alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """A folder per shard, rows in curve order, so that Parquet's own statistics prune inside files too."""
    assigned.repartition("shard", F.floor(F.col("slot") / RUN_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def manifest(assigned: DataFrame, dimensions: list[str]) -> DataFrame:
    """Smallest and largest value of each dimension for every run of rows of every shard."""
    stats = [f(c).alias(f"{name}_{c}") for c in dimensions for name, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard", F.floor(F.col("slot") / RUN_ROWS).alias("run")).agg(*stats, F.count(F.lit(1)).alias("rows"))


def prune(runs: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The runs that may hold rows with every given dimension between its two bounds."""
    for c, (low, high) in ranges.items():
        runs = runs.where((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return runs


def document_shards(docs: DataFrame) -> DataFrame:
    """Documents by size, language, source and id: the contract's row per document."""
    slim = docs.select("doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    axes = [quantile_cells(slim, "size"), hashed_cells("lang"), hashed_cells("source"), linear_cells(slim, "doc_id")]
    return assign(slim, axes, "doc_id")
