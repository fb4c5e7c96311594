"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

``fit`` takes a bounded sample of labelled documents, keeps the words that labels speak through (likelihood
ratio and share among toxic examples, a bounded number), counts in how many documents of the whole corpus each
occurs, and indexes the examples' TF-IDF vectors. All other words leave the vectors: the cosine is one of telling
words, not of whole texts, and a long text that quotes one of them scores like that word alone. The index is inverted, its postings cut into blocks of
examples with the largest weight of each word and block; a search visits blocks by falling upper bound and
stops when no later block can hold a nearer example, so the k nearest are exact. Votes weigh by inverse
distance; a monotone curve fitted by leaving each example out turns votes into probabilities.

The model is broadcast; its size is bounded by ``EXAMPLES``, ``FEATURES`` and ``BLOCK``. Documents are scored
in their own tasks, whole texts at a time.

Defined results: null, empty and long texts are scored like any other; a text without an indexed word has no
neighbour and gets the share of toxic ones among such examples; equal similarities are taken in the order of
the examples; without labels every score is 0; rows with a null label or id are not learned from.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotate, crc_mod, stage, utf8, words_of

#: Bounds of the model: labelled examples, words, examples per block, neighbours.
EXAMPLES, FEATURES, BLOCK, NEIGHBOURS = 16_384, 4_096, 64, 15
#: A word is kept if its share among toxic examples is at least twice the mean, and so far above it that among all
#: words tried this many would be kept by chance.
LIFT, CHANCE = 2.0, 0.01
#: Examples of one label are near copies from this Jaccard similarity of five-word shingles on.
SIMILAR = 0.8
THRESHOLD = 0.7
_CACHE = 50_000
#: Bytes of texts in a batch, whose words are Python objects.
_BATCH = 1_000_000


class NeighbourIndex:
    """Block-max inverted index of unit TF-IDF vectors, with votes and their calibration."""

    def __init__(self, vectors: list[dict[int, float]], labels: list[int], ids: list[int], n_features: int) -> None:
        # examples with the same leading word stand together, so that block maxima differ
        order = sorted(range(len(vectors)), key=lambda i: (max(vectors[i], key=vectors[i].get), ids[i]) if vectors[i] else (n_features, ids[i]))
        order = [i for i in order if vectors[i]]
        empty = [labels[i] for i in range(len(vectors)) if not vectors[i]]
        self.prior = sum(labels) / len(labels) if labels else 0.0
        self.no_neighbour = (sum(empty) + self.prior) / (len(empty) + 1)
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.blocks = -(-len(order) // BLOCK)
        self.largest = np.zeros((n_features, self.blocks), np.float64)
        self.postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        raw: dict[tuple[int, int], list] = {}
        for place, i in enumerate(order):
            for f, w in vectors[i].items():
                raw.setdefault((f, place // BLOCK), []).append((place, w))
                self.largest[f, place // BLOCK] = max(self.largest[f, place // BLOCK], w)
        for key, rows in raw.items():
            self.postings[key] = (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]))
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self._calibrate([vectors[i] for i in order])

    def nearest(self, vector: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, as (cosine, place); exact."""
        fs = list(vector)
        q = np.array([vector[f] for f in fs])
        bounds = q @ self.largest[fs]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) >= k and bounds[b] < -best[-1][0] - 1e-12:
                break
            score = np.zeros(BLOCK)
            for f, w in zip(fs, q):
                hit = self.postings.get((f, b))
                if hit is not None:
                    score[hit[0] - b * BLOCK] += w * hit[1]
            best += [(-round(float(score[j]), 12), int(b * BLOCK + j)) for j in np.flatnonzero(score > 0) if b * BLOCK + j != without]
            best = sorted(best)[:k]
        return [(-s, place) for s, place in best]

    def vote(self, found: list[tuple[float, int]]) -> float:
        weight = np.array([1.0 / (1.02 - min(s, 1.0)) for s, _ in found])
        return float(weight @ self.labels[[p for _, p in found]] / weight.sum())

    def _calibrate(self, vectors: list[dict[int, float]]) -> None:
        """Monotone regression (pooled neighbours) of the labels on the votes of the other examples."""
        votes = []
        for place, v in enumerate(vectors):
            found = self.nearest(v, NEIGHBOURS, place)
            if found:
                votes.append((self.vote(found), self.labels[place]))
        pools: list[list[float]] = []
        for x, y in sorted(votes):
            pools.append([x, x, y, 1.0])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                a, b = pools[-2], pools.pop()
                pools[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
        if pools:
            xs = [x for p in pools for x in (p[0], p[1])]
            ys = [(p[2] + self.prior) / (p[3] + 1.0) for p in pools for _ in "ab"]
            self.curve = (np.array(xs), np.maximum.accumulate(np.array(ys)))


class ToxicityModel:
    """Words with their IDF, and the index of examples."""

    def __init__(self, words: list[str], frequency: dict[str, int], n_docs: int, examples: list[tuple[int, int, dict[str, int]]]) -> None:
        self.place = {w.encode(): k for k, w in enumerate(words)}
        self.idf = np.array([np.log((1 + n_docs) / (1 + frequency.get(w, 0))) + 1.0 for w in words])
        vectors = [self._vector({w.encode(): c for w, c in tf.items()}) for _, _, tf in examples]
        self.index = NeighbourIndex(vectors, [y for _, y, _ in examples], [i for i, _, _ in examples], len(words))
        self._cache: dict[tuple, tuple[float, list[int]]] = {}

    def _vector(self, tf: dict[bytes, int]) -> dict[int, float]:
        raw = {self.place[w]: (1.0 + np.log(c)) * self.idf[self.place[w]] for w, c in tf.items() if w in self.place}
        norm = np.sqrt(sum(x * x for x in raw.values()))
        return {f: float(x / norm) for f, x in sorted(raw.items())}

    def score(self, text: bytes | None) -> tuple[float, list[int]]:
        """Probability of label 1, and the ids of the nearest examples."""
        tf = Counter(filter(self.place.__contains__, words_of(text)))
        key = tuple(sorted(tf.items()))
        if key not in self._cache:
            if len(self._cache) >= _CACHE:
                self._cache.clear()
            found = self.index.nearest(self._vector(tf), NEIGHBOURS) if tf else []
            p = float(np.interp(self.index.vote(found), *self.index.curve)) if found else self.index.no_neighbour
            self._cache[key] = (min(1.0, max(0.0, p)), [int(self.index.ids[i]) for _, i in found[:3]])
        return self._cache[key]

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}


def _shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle."""
    grams = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return np.unique(np.frombuffer(b"".join(blake2b(g, digest_size=8).digest() for g in grams), "<u8"))


def _near_copy_keys(grams: np.ndarray, seeds: int = 3) -> list[int]:
    """The smallest hash of the shingles under each seed: near copies mostly share one."""
    out = []
    for k in range(1, seeds + 1):
        h = (grams ^ np.uint64(0x9E3779B97F4A7C15 * k & 2**64 - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(int((h ^ h >> np.uint64(31)).min().astype(np.int64)))
    return out


class _Copies:
    """Examples in order: each is new, or a near copy of one that came before with the same label.

    The keys only propose; a copy has a Jaccard similarity of at least ``SIMILAR`` over the shingles. Shingles are
    held for examples that share a key with a later one.
    """

    def __init__(self, rows: list[tuple[int, list[int]]]) -> None:
        self.left = Counter(key for y, keys in rows for key in self._keys(y, keys))
        self.under: dict[tuple, list[int]] = {}
        self.grams: list[np.ndarray] = []

    @staticmethod
    def _keys(y: int, keys: list[int]) -> list[tuple]:
        return [(y, k, key) for k, key in enumerate(keys)]

    def is_new(self, y: int, keys: list[int], grams: np.ndarray) -> bool:
        mine = self._keys(y, keys)
        self.left.subtract(mine)
        near = [g for g in (self.grams[i] for i in sorted({i for key in mine for i in self.under.get(key, ())}))
                if min(len(g), len(grams)) >= SIMILAR * max(len(g), len(grams)) - 1e-9]
        if near:
            sizes = np.array([len(g) for g in near])
            seen = np.concatenate(near)
            hit = grams[np.minimum(np.searchsorted(grams, seen), len(grams) - 1)] == seen
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            if (both >= SIMILAR * (sizes + len(grams) - both) - 1e-9).any():
                return False
        if later := [key for key in mine if self.left[key]]:
            self.grams.append(grams)
            for key in later:
                self.under.setdefault(key, []).append(len(self.grams) - 1)
        return True


def _without_copies(examples: DataFrame) -> DataFrame:
    """Examples (``at, id, y, keys, grams`` and more) but near copies of one with a smaller id and the same label,
    as copies would make any of their words look telling."""
    order = examples.orderBy("id", "y", "at")
    copies = _Copies([(r.y, r["keys"]) for r in order.select("y", "keys").collect()])
    new = [(r.at,) for r in order.select("at", "y", "keys", "grams").toLocalIterator() if copies.is_new(r.y, r["keys"], np.frombuffer(bytes(r.grams), "<u8"))]
    return examples.join(F.broadcast(examples.sparkSession.createDataFrame(new, "at bigint")), "at", "left_semi")


def _terms(docs: DataFrame, keep=None, row: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or those given) and its distinct words with counts (of ``keep``, a broadcast set, if given);
    without ``keep`` also shingles and near-copy keys."""

    def fn(batch):
        out, keys, grams = [], [], []
        for t in utf8(batch.column("text")):
            ws = words_of(t)
            out.append([(w.decode(), c) for w, c in Counter(ws if keep is None else filter(keep.value.__contains__, ws)).items()])
            g = _shingles(ws) if keep is None else None
            keys.append([] if g is None else _near_copy_keys(g))
            grams.append(None if g is None else g.tobytes())
        return {"terms": out, "keys": keys, "grams": grams}

    return annotate(docs, {"text": F.col("text")}, fn, "terms array<struct<w:string,c:int>>, keys array<bigint>, grams binary", row, _BATCH)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    At most ``EXAMPLES`` labels are used, chosen by the hash of their id; document frequencies come from all
    of ``docs``.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    some = known.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(EXAMPLES)
    picked = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(some), "id")  # EXAMPLES rows at most
    found = stage(_terms(picked).select(F.monotonically_increasing_id().alias("at"), "row.id", "row.y", "terms", "keys", "grams"), "examples")
    terms = _without_copies(found).select("id", "y", "terms").persist()
    n, n1 = terms.agg(F.count(F.lit(1)), F.sum("y")).first()
    n1 = n1 or 0
    if not n or not n1 or n1 == n:
        terms.unpersist()
        return ToxicityModel([], {}, 0, [(0, int(bool(n1)), {})] if n else [])
    df = (terms.select("y", F.explode("terms.w").alias("w")).groupBy("w")
          .agg(F.sum("y").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("b")).where("b > 1").persist())
    least = 2.0 * float(np.log(max(1, df.count()) / CHANCE))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    ratio = 2 * (part(a, b * n1 / n) + part(b - a, b * (n - n1) / n) + part(n1 - a, (n - b) * n1 / n) + part(n - n1 - b + a, (n - b) * (n - n1) / n))
    chosen = df.withColumn("ratio", ratio).where((F.col("ratio") >= least) & (a / b >= LIFT * n1 / n)).orderBy(F.desc("ratio"), "w").limit(FEATURES)
    words = sorted(r.w for r in chosen.select("w").collect())
    keep = spark.sparkContext.broadcast(frozenset(w.encode() for w in words))
    examples = [(r.id, r.y, {t.w: t.c for t in r.terms}) for r in
                terms.select("id", "y", F.filter("terms", lambda t: t.w.isin(words)).alias("terms")).collect()] if words else [
                    (r.id, r.y, {}) for r in terms.select("id", "y").collect()]
    terms.unpersist()
    df.unpersist()
    counts = _terms(docs.select("text", F.lit(1).alias("one")), keep, ["one"]).select(F.explode("terms.w").alias("w")).groupBy("w").count()
    frequency = {r.w: r["count"] for r in counts.collect()}
    return ToxicityModel(words, frequency, docs.count(), sorted(examples, key=lambda e: (e[0], e[1])))


def score(docs: DataFrame, model: ToxicityModel, text: Column) -> DataFrame:
    """``row``, ``score`` and ``evidence`` (ids of the nearest examples)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch):
        got = [sent.value.score(t) for t in utf8(batch.column("text"))]
        return {"score": [g[0] for g in got], "evidence": [g[1] for g in got]}

    return annotate(docs, {"text": text}, fn, "score double, evidence array<bigint>", most=_BATCH)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels without the held-out third (crc32 of the id modulo 3 is 1)."""
    return labels.where(crc_mod(F.col("doc_id"), 3) != 1)
