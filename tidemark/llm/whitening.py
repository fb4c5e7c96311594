"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration over distributed passes.

Entries become whole numbers x = floor(256 c). The *fit list* holds each distinct x vector once (one shuffle, with
partial aggregation, so copies cost nothing), is written to the shared folder, and is all that the passes read. A pass
multiplies the centred covariance with a block Q of at most ``COMPONENTS + GUARDS + FRESH`` columns: every task centres
its rows, computes Xᵀ(XQ) for them in batches, and the partial products are summed by dimension in Spark. Only products
of size dimensions x block come to the driver; they do not grow with the rows. The covariance itself is never formed.

One round of the iteration:

1. the polynomial recurrence of Chebyshev on [0, c] (c: the block's smallest kept Ritz value; a covariance has no
   negative eigenvalues) runs over passes, which keeps the unwanted spectrum below 1 and lets the rest grow; its degree
   is such that the largest eigenvalue grows by ``GROWTH`` at most, so the block does not collapse;
2. QR of the filtered block, with ``FRESH`` new random columns, so that a direction that all columns missed comes in;
3. Rayleigh-Ritz: one more pass gives QᵀVQ, its eigenvectors, and the residual of every wanted pair.

It is *certified* when the residuals of the wanted pairs are at most ``PRECISION`` x the largest eigenvalue, or within
``ROUNDS`` rounds no longer fall (they are then at the rounding of doubles). ``identity_error`` is measured afterwards
on the fit list, in a pass of its own.

Defined results: rows whose vector is null, or holds nulls, NaN or infinities, have none; nor have vectors whose length
is not the commonest one (ties: the longer). Directions with an eigenvalue of at most ``RANK`` x trace are no
components, so fewer than four, or none at all, come out of few distinct vectors; an empty table gives an empty table.
Repeated rows count once in the fit and each get their result. ``deviation`` is exact, and null where it does not fit
into 64 bits. The row travels inside one struct, so columns of any name survive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotate, stage

#: Components that are asked for; columns beside them that speed the iteration; new random columns a round.
COMPONENTS, GUARDS, FRESH = 4, 16, 2
#: Highest degree and growth of a filter, rounds at most, and the residual (in largest eigenvalues) that ends them.
DEGREE, GROWTH, ROUNDS, PRECISION = 12, 1e8, 60, 1e-14
#: Smallest eigenvalue of a component, as a share of the trace.
RANK = 1e-11
_SEED = 20


def whole(vector: Column | str) -> Column:
    """x of a vector: each entry c as floor(256 c); null if an entry is null or not finite, or the vector is null."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < math.inf, F.lit(False)))
    return F.when(finite, F.transform(v, lambda c: F.floor(c.cast("double") * 256).cast("bigint")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Fit:
    """The fit list and its exact sums."""

    rows: DataFrame
    d: int
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def pass_(self, partial: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
        """Sum over the tasks of ``partial``, a matrix that each computes from its centred rows, batch by batch."""
        d, mean = self.d, self.mean
        names = [f"c{k}" for k in range(width)]

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for b in batches:
                total += partial(_matrix(b.column("x"), d) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *map(pa.array, total.T)], names=["i", *names])

        parts = self.rows.mapInArrow(fn, "i int, " + ", ".join(f"{c} double" for c in names))
        out = np.zeros((height, width))
        for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # `height` rows
            out[r.i] = r[1:]
        return out / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times a block: XᵀXQ / n over the centred rows."""
        return self.pass_(lambda z: z.T @ (z @ q), self.d, q.shape[1])

    def trace(self) -> float:
        return math.fsum(self.pass_(lambda z: (z * z).sum(0)[:, None], self.d, 1)[:, 0])


def fit_list(x: DataFrame) -> Fit:
    """Each distinct vector of column ``x`` once, of the commonest length, and exact sums."""
    x = x.where(F.col("x").isNotNull())
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0].d if sizes else 0
    rows = stage(x.where(F.size("x") == d).select("x").distinct(), "fit")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            n += b.num_rows
            m = _matrix(b.column("x"), d)
            far = b.num_rows and d and int(np.abs(m).max()) > 2**62 // b.num_rows
            total = [s + int(t) for s, t in zip(total, (m.astype(object) if far else m).sum(0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([*range(d), d], pa.int32()), pa.array([str(s) for s in [*total, n]])], names=["i", "s"])

    found = {r.i: int(r.s) for r in rows.mapInArrow(fn, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return Fit(rows, d, found.get(d, 0), [found.get(i, 0) for i in range(d)])


@dataclass
class Whitening:
    """Components (columns), their eigenvalues and what is reported of the fit."""

    fit: Fit
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def _filtered(fit: Fit, q: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance, mapped from [0, cut] to [-1, 1], times a block."""
    half = cut / 2
    before, now = q, (fit.times(q) - half * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (fit.times(now) - half * now) / half - before
    return now / np.linalg.norm(now, axis=0)


def components(fit: Fit, wanted: int = COMPONENTS) -> Whitening:
    """The leading ``wanted`` components of the fit list, certified."""
    none = np.zeros((fit.d, 0))
    trace = fit.trace() if fit.n > 1 and fit.d else 0.0
    if trace <= 0:
        return Whitening(fit, none, np.zeros(0), trace, 0.0, 0.0, 1)
    rng = np.random.default_rng(_SEED)
    block = min(fit.d, wanted + GUARDS + FRESH)
    kept = block if block == fit.d else block - FRESH
    q = np.linalg.qr(rng.standard_normal((fit.d, block)))[0]
    passes, best, since = 1, math.inf, 0
    for turn in range(ROUNDS):
        vq = fit.times(q)
        h = q.T @ vq
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        ritz = q @ u
        top = min(wanted, block)
        residual = float(np.linalg.norm(vq @ u[:, :top] - ritz[:, :top] * values[:top], axis=0).max() / values[0])
        passes += 1
        since = 0 if residual < best / 2 else since + 1
        best = min(best, residual)
        if block == fit.d or residual <= PRECISION or (residual < 1e-12 and since >= 2):
            break
        cut = max(float(values[kept - 1]), RANK * trace)
        degree = max(1, min(DEGREE, int(math.acosh(GROWTH) / max(math.acosh(max(2 * values[0] / cut - 1, 1.0)), 1e-9))))
        filtered = _filtered(fit, ritz[:, :kept], cut, degree)
        passes += degree
        q = np.linalg.qr(np.column_stack((filtered, rng.standard_normal((fit.d, block - kept)))))[0]
    else:
        raise RuntimeError(f"the components are not certified after {ROUNDS} rounds: residual {residual}")
    keep = values[:wanted] > RANK * trace
    vectors, values = ritz[:, :wanted][:, keep], values[:wanted][keep]
    k = len(values)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(k)] < 0, -1.0, 1.0)  # the largest entry is positive
    scale = vectors / np.sqrt(values)
    moments = fit.pass_(lambda z: np.column_stack(((w := z @ scale).T @ w, w.sum(0))), k, k + 1)
    covariance = moments[:, :k] - np.outer(moments[:, k], moments[:, k])
    return Whitening(fit, vectors, values, trace, residual, float(np.abs(covariance - np.eye(k)).max()), passes + 1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)², exact; null beyond 64 bits."""
    s = np.array(sums, object)
    most = max([n * int(np.abs(x).max()) if x.size else 0, *(abs(v) for v in sums)])
    if 4 * most * most * max(1, x.shape[1]) < 2**63:
        return ((n * x - s.astype(np.int64)) ** 2).sum(1).tolist()
    return [v if v < 2**63 else None for v in (((n * x.astype(object) - s) ** 2).sum(1)).tolist()]


def whiten(rows: DataFrame, vector: str, model: Whitening, keep: list[str] | None = None) -> DataFrame:
    """``row``, ``deviation`` and ``whitened`` (one entry per component) of every row with a usable vector."""
    fit = model.fit
    d, n, sums, mean = fit.d, fit.n, fit.sums, fit.mean if fit.n else np.zeros(0)
    scale = model.vectors / np.sqrt(model.values)

    def fn(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch.column("x"), d)
        w = (x - mean) @ scale
        ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
        return {"deviation": deviations(x, n, sums), "whitened": pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))}

    x = whole(vector)
    return annotate(rows.where(F.size(x) == max(d, 1)), {"x": x}, fn, "deviation bigint, whitened array<double>", keep)


def report(rows: DataFrame) -> DataFrame:
    """The contract's row per vector and component."""
    model = components(fit_list(rows.select(whole("embedding").alias("x"))))
    got = whiten(rows, "embedding", model, ["vec_id"])
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return got.select("row.vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation").select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.fit.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
