"""Shared helpers: staging in the cluster's folder, row-preserving Arrow maps, word tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()

#: Byte table of the word rule: A-Z become a-z, other ASCII but 0-9 and a-z separates, non-ASCII bytes are word bytes.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they need no installed copy."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, whose tasks run on this machine, may go without one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-llm-")
    return _LOCAL_ROOTS[app]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/llm/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there, lost executors redo nothing before."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digest128(text: Column) -> Column:
    """First 16 bytes of SHA-256 of the UTF-8 text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def annotate(docs: DataFrame, inputs: dict[str, Column], fn: Callable[[pa.RecordBatch], dict[str, Iterable]],
             outputs: str, keep: list[str] | None = None, most: int = 8_000_000) -> DataFrame:
    """Rows of ``docs`` as one struct ``row`` next to the columns that ``fn`` computes from ``inputs``.

    The row travels untouched inside the struct, so columns of any name or type survive and cannot
    clash with the outputs. ``outputs`` is a DDL list; ``fn`` gets batches that hold the inputs alone.
    ``keep`` limits the row to some columns; ``most`` is how many bytes of inputs ``fn`` gets at once, about.
    """
    names = list(inputs)
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), *[c.alias(f"in_{k}") for k, c in inputs.items()])
    spark = docs.sparkSession
    added = spark.createDataFrame([], outputs).schema
    schema = narrow.select("row").schema
    for f in added:
        schema = schema.add(f.name, f.dataType, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for b in batches:
            for part in bounded(b, [f"in_{k}" for k in names], most):
                given = pa.RecordBatch.from_arrays([part.column(f"in_{k}") for k in names], names=names)
                out = fn(given)
                types = types or arrow_types(added)
                cols = [part.column("row"), *[_array(out[f.name], types[f.name]) for f in added]]
                yield pa.RecordBatch.from_arrays(cols, names=["row", *[f.name for f in added]])

    return narrow.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, columns: list[str], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of the given columns each; one row at least."""
    if batch.num_rows == 0:
        return
    size = sum(batch.column(c).nbytes for c in columns)
    step = max(1, int(batch.num_rows * most / max(size, most)))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def arrow_types(schema) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema}


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) and values.type == kind else pa.array(values, type=kind)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow string column as bytes."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n
