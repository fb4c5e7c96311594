"""Near-duplicate groups by BagMinHash over word shingles.

A document is the multiset of its shingles of five words (of all its words if it has fewer); similarity is
the multiset Jaccard, sum of the smaller counts over sum of the larger ones, and documents of 0.8 or more are
linked. Classes are the connected components of the links.

* **Signature.** Every shingle owns a Poisson process on (0, inf) of discretised weight; a shingle that occurs
  w times contributes the points below w. The process is hierarchical: weight is cut into (0, 1], (1, 2],
  (2, 4], (4, 8], ... with independent processes of the interval's length as rate; where w ends inside an
  interval, its points are split by halves, each by a hash of the point, down to unit levels. Every point
  falls on one of ``SLOTS`` slots, which keeps its earliest one. Two signatures agree at a slot with the
  probability of the weighted Jaccard. Points are drawn in order of time and only up to the moment when all
  slots are taken, for all shingles of a document at once.
* **Bands.** ``BANDS`` bands of ``ROWS`` slots; a pair of similarity 0.8 shares one with probability 0.9998.
* **Verification.** Candidates' multisets are compared in full.

No group of documents is expanded into all its pairs. Equal texts are one entity. In the first round every
entity is compared with the smallest entity of each of its bands' buckets, in the second with the smallest of
each class that meets there; the last round compares what is left, pairs of entities of different classes in
one bucket whose sketches and maps of shingles leave a link possible, so no link between different classes is lost. Rounds work on tables in the shared folder.

Defined results: equal texts are one class, also empty ones (null counts as empty); texts without words are
linked to equal texts only; repeated rows are members like others; a null id sorts last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotate, bounded, digest128, stage, utf8, words_of

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 36, 7
SLOTS = BANDS * ROWS
#: Candidates whose signatures agree at fewer slots (by one byte each), or differ at more of them (by two bits each), are
#: not verified: at a similarity of 0.8 either lies over 4.5 standard deviations off (a chance of 3 in a million).
AGREE, DIFFER = 172, 64
#: Bits of the map of a document's shingles: two documents differ in as many shingles at least as in bits.
MAP_BITS = 1024
_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingler:
    """64-bit hashes of the shingles of texts; hashes of words are kept from text to text."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _ids(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 300_000:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = word_hash(w)
            return np.array([known[w] for w in words], np.uint64)

    def many(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' shingles in turn, and the place where each text's hashes begin (and the last end)."""
        ids = [self._ids(words_of(t)) for t in texts]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint64)
        # shorter texts are one shingle, closed by as many marks as words are missing
        pad = np.where((n > 0) & (n < SHINGLE), SHINGLE - n, 0)
        flat = np.insert(flat, np.repeat(np.cumsum(n), pad), _G)
        n = n + pad
        h = np.full(max(0, len(flat) - SHINGLE + 1), np.uint64(SHINGLE))
        for k in range(SHINGLE):
            h = _mix((h + _G) ^ flat[k : k + len(h)])
        ends = np.cumsum(n)
        crossing = np.zeros(len(flat), bool)  # windows that would reach into the next text
        for k in range(1, SHINGLE):
            crossing[ends[n >= SHINGLE] - k] = True
        h = h[~crossing[: len(h)]]
        return h, np.concatenate(([0], np.cumsum(np.maximum(n - SHINGLE + 1, 0))))

    def hashes(self, text: bytes | None) -> np.ndarray:
        return self.many([text])[0]


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sums of the smaller and of the larger counts of two multisets of hashes."""
    x, i = np.unique(a, return_counts=True)
    y, j = np.unique(b, return_counts=True)
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(i[p], j[q]).sum())
    return both, len(a) + len(b) - both


def _intervals(weights: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """(indices of elements that reach into it, low, high) of the intervals (0,1], (1,2], (2,4], ..."""
    out, low, high = [(np.arange(len(weights)), 0, 1)], 1, 2
    while (some := np.flatnonzero(weights > low)).size:
        out.append((some, low, high))
        low, high = high, 2 * high
    return out


def _below(points: np.ndarray, weights: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether each point of (low, high], split by halves, lies below its element's weight."""
    a, b = np.full(len(points), low), np.full(len(points), high)
    h = points
    while (b - a > 1).any():
        h = _mix(h + _G)
        mid, open_ = (a + b) // 2, b - a > 1
        right = open_ & ((h & np.uint64(1)) == 1)
        left = open_ & ~right
        a, b = np.where(right, mid, a), np.where(left, mid, b)
    return a < weights


def signatures(shingles: np.ndarray, starts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """64-bit identity of the earliest point at each slot, a row per document; documents have a shingle at least."""
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    order = np.argsort(_mix(shingles + doc.astype(np.uint64) * _G))  # equal shingles of a document stand together
    h, d = shingles[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.empty(0, np.int64)
    elements, owner, counts = h[new], d[new], np.diff(np.append(new, len(h)))
    until = slots * (np.log(slots) + 3.0) / np.maximum(np.diff(starts), 1)  # all slots are taken by then, most often
    when, which = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)

    def put(t: np.ndarray, point: np.ndarray, own: np.ndarray, weight: np.ndarray, low: int, high: int) -> None:
        """Points below their element's weight go to their slots if they are earlier than what is there."""
        slot = own * slots + (_mix(point) % np.uint64(slots)).astype(np.int64)
        keep = np.flatnonzero(t < when[slot])
        if high - low > 1:
            keep = keep[_below(point[keep], weight[keep], low, high)]
        keep = keep[np.argsort(-t[keep])]  # the earliest is written last
        when[slot[keep]], which[slot[keep]] = t[keep], point[keep]

    todo = np.ones(n, bool)
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        for some, low, high in _intervals(counts[mine]):
            some = mine[some]
            seed = _mix(elements[some] ^ _mix(np.full(1, np.uint64(low + 1)) * _G))
            weight, own, rate = counts[some], owner[some], high - low
            mean = until[own] * rate  # points to come; elements with about as many are drawn together
            size = np.ceil(np.log2(mean + 3 * np.sqrt(mean) + 2)).astype(np.int64)
            for c in np.unique(size):
                here = np.flatnonzero(size == c)
                time, drawn = np.zeros(len(here)), 0
                while len(here):
                    state = _mix(seed[here, None] + (np.arange(drawn + 1, drawn + 1 + (1 << c), dtype=np.uint64) * _G)[None, :])
                    times = time[:, None] + np.cumsum(-np.log(_unit(state)) / rate, axis=1)
                    row, col = np.nonzero(times < until[own[here], None])
                    put(times[row, col], _mix(state[row, col] ^ np.uint64(0x5851F42D4C957F2D)), own[here[row]], weight[here[row]], low, high)
                    more = times[:, -1] < until[own[here]]
                    here, time, drawn = here[more], times[more, -1], drawn + (1 << c)
        todo &= ~np.isfinite(when.reshape(n, slots)).all(axis=1)
        until = np.where(todo, until * 2, until)
    return which.reshape(n, slots)


def signature(shingles: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    return signatures(shingles, np.array([0, len(shingles)]), slots)[0]


def bands(sigs: np.ndarray) -> np.ndarray:
    """A hash per band, a row per document."""
    h = np.tile(np.arange(1, BANDS + 1).astype(np.uint64) * _G, (len(sigs), 1))
    rows = sigs.reshape(len(sigs), BANDS, ROWS)
    for k in range(ROWS):
        h = _mix(h ^ rows[:, :, k])
    return h.view(np.int64)


def _signatures(docs: DataFrame) -> DataFrame:
    """``id``, ``key``, ``bands``, ``sketch`` (a byte per slot) and ``marks``: two bits per slot as two planes of
    four words, the map of shingles, and their number. No bands without words."""
    def fn(batch):
        shingler, out = Shingler(), {"bands": [], "sketch": [], "marks": []}
        for part in bounded(batch, ["text"], 1_000_000):
            h, starts = shingler.many(utf8(part.column("text")))
            some = np.diff(starts) > 0
            sigs = signatures(h, np.concatenate(([0], np.cumsum(np.diff(starts)[some]))))
            b, s = iter(bands(sigs).tolist()), iter((sigs & np.uint64(255)).astype(np.uint8))
            planes = [np.pad((sigs >> np.uint64(k)) & np.uint64(1) == 1, ((0, 0), (0, 256 - SLOTS))) for k in (8, 9)]
            held = np.zeros((len(some), MAP_BITS), bool)
            held[np.repeat(np.arange(len(some)), np.diff(starts)), (h % np.uint64(MAP_BITS)).astype(np.int64)] = True
            m = iter(np.hstack([*(np.packbits(p, axis=1).view(np.int64) for p in planes), np.packbits(held[some], axis=1).view(np.int64), np.diff(starts)[some, None]]).tolist())
            for has in some:
                out["marks"].append(next(m) if has else [])
                out["bands"].append(next(b) if has else [])
                out["sketch"].append(next(s).tobytes() if has else b"")
        return out

    slim = docs.select("id", "key", "text")
    return annotate(slim, {"text": F.col("text")}, fn, "bands array<bigint>, sketch binary, marks array<bigint>").select("row.id", "row.key", "bands", "sketch", "marks")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected with) of an undirected graph (``a``, ``b``); roots have no row.

    Alternates linking every node's larger neighbours and its smaller ones to its smallest neighbour until the
    graph is a forest of stars; the number of rounds is logarithmic in practice. Edges never reach the driver.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _stars(e):
        # larger neighbours to the smallest neighbour
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # smaller neighbours to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = stage(small.where("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    up = e.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    ends = e.select(F.col("b").alias("a")).distinct()
    return up.join(ends.withColumn("hub", F.lit(True)), "a", "left").where("n > 1 OR hub").isEmpty()


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """``root`` after the classes that ``links`` (of nodes) connect became one."""
    ra, rb = root.select(F.col("node").alias("a"), F.col("root").alias("x")), root.select(F.col("node").alias("b"), F.col("root").alias("y"))
    between = links.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    top = components(between)
    moved = root.join(top.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return stage(moved.union(top), "roots")


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose multisets overlap enough."""
    left = sketches.select(F.col("eid").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("eid").alias("b"), F.col("sketch").alias("sb"))

    def agree(batch):
        x = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint8).reshape(-1, SLOTS)
        y = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint8).reshape(-1, SLOTS)
        return {"agree": pa.array((x == y).sum(axis=1), pa.int32())}

    close = annotate(pairs.join(left, "a").join(right, "b"), {"sa": F.col("sa"), "sb": F.col("sb")}, agree, "agree int")
    close = stage(close.where(F.col("agree") >= AGREE).select("row.a", "row.b"), "close")

    def enough(batch):
        shingler, out = Shingler(), []
        kept, last = None, None
        for t, u in zip(utf8(batch.column("ta")), utf8(batch.column("tb"))):
            if u != last:
                last, kept = u, shingler.hashes(u)
            both, all_ = overlap(shingler.hashes(t), kept)
            out.append(both >= THRESHOLD * all_ - 1e-9)
        return {"same": out}

    ta = texts.select(F.col("eid").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("eid").alias("b"), F.col("text").alias("tb"))
    joined = close.join(ta, "a").join(tb, "b")
    got = annotate(joined.select("a", "b", "ta", "tb"), {"ta": F.col("ta"), "tb": F.col("tb")}, enough, "same boolean")
    return stage(got.where("same").select("row.a", "row.b"), "links")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id with ``class_id`` (smallest id of its class), ``class_size`` and ``kept``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), digest128(F.col(text)).alias("key"), F.col(text).alias("text"))
    signed = stage(_signatures(rows), "signatures")
    entities = signed.groupBy("key").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks"))
    entities = stage(entities.withColumn("eid", F.monotonically_increasing_id()), "entities")

    banded = entities.select("eid", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("eid").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(banded.join(shared, "bucket").select("bucket", "eid", "least"), "met")  # buckets of two entities or more
    involved = met.select("eid").distinct()
    sketches = stage(entities.join(involved, "eid").select("eid", "key", "first_id", "sketch"), "sketches")
    # one text per entity that met another: by id and digest, so that repeated ids with other texts don't match
    texts = rows.select(F.col("id").alias("first_id"), "key", "text").join(sketches.select("first_id", "key", "eid"), ["first_id", "key"])
    nulls = rows.where(F.col("id").isNull()).join(sketches.where(F.col("first_id").isNull()).select("key", "eid"), "key")
    # A row may be there many times: its text counts once, or a pair of such rows would be compared once per pair of copies.
    texts = stage(texts.select("eid", "text").union(nulls.select("eid", "text")).dropDuplicates(["eid"]), "texts")

    # first round: every entity with the smallest one of each of its buckets
    links = _verified(met.where("eid <> least").select(F.col("eid").alias("a"), F.col("least").alias("b")).distinct(), sketches, texts)
    root = components(links)

    for last in (False, True):
        classed = met.select("bucket", "eid").join(root.withColumnRenamed("node", "eid"), "eid", "left").select("bucket", "eid", F.coalesce("root", "eid").alias("c"))
        meet = classed.groupBy("bucket", "c").agg(F.min("eid").alias("eid"))
        several = meet.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min_by("eid", "c").alias("least")).where("c0 < c1")
        if not last:
            pairs = meet.join(several, "bucket").where("eid <> least").select(F.col("eid").alias("a"), F.col("least").alias("b"))
        else:
            open_ = stage(classed.join(several.select("bucket"), "bucket", "left_semi").join(entities.select("eid", "marks"), "eid"), "open")
            other = open_.select("bucket", F.col("eid").alias("b"), F.col("c").alias("d"), F.col("marks").alias("n"))
            unlike = " + ".join(f"bit_count((marks[{k}] ^ n[{k}]) | (marks[{k + 4}] ^ n[{k + 4}]))" for k in range(4))
            apart = " + ".join(f"bit_count(marks[{k}] ^ n[{k}])" for k in range(8, 8 + MAP_BITS // 64))
            total, share = f"(marks[{8 + MAP_BITS // 64}] + n[{8 + MAP_BITS // 64}])", (1 - THRESHOLD) / (1 + THRESHOLD)
            near = F.expr(f"c > d AND {unlike} <= {DIFFER} AND {apart} <= {total} * {share} + 1e-6D")
            pairs = open_.withColumnRenamed("eid", "a").join(other, ["bucket"]).where(near).select("a", "b")
        pairs = stage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
        more = _verified(pairs, sketches, texts)
        if not more.isEmpty():
            root = _joined(root, more)

    named = entities.select("eid", "key", "first_id").join(root.withColumnRenamed("node", "eid"), "eid", "left").withColumn("root", F.coalesce("root", "eid"))
    sizes = signed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    named = stage(named.join(sizes, "key"), "named")
    total = named.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    by_key = stage(named.join(total, "root").select("key", "class_id", "class_size"), "classes")
    return signed.select("id", "key").join(by_key, "key").select(
        F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row of each class: that of the smallest id."""
    keep = classes(docs, id_col, text).where("kept").select(F.col(id_col).alias("w_id"), F.col("key").alias("w_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest128(F.col(text)).alias("key"))
    won = rows.join(keep, (F.col("key") == F.col("w_key")) & F.col("id").eqNullSafe(F.col("w_id")), "left_semi")
    return won.dropDuplicates(["id", "key"]).select("row.*")
