"""Byte-level BPE: ranked merges folded over the bytes of distinct words, by Spark's higher-order functions.

The rank file becomes a literal map (a hash table from pairs of pieces to the rank of the joined piece). ``encoded``
folds a word: the bytes are the first pieces, every step joins the adjacent pair of lowest rank, leftmost
first, until none has a rank. It runs on distinct words, not on occurrences:

1. words are counted over the whole corpus (map-side counters, one shuffle of distinct words);
2. the most frequent ones, ``DICTIONARY`` at most, are folded once and broadcast;
3. each document's remaining distinct words are folded next to it, in the same stage;
4. the document's ids are put together in word order, and decoded by concatenating the ids' byte pieces.

Documents are never shuffled. The broadcast is bounded by ``DICTIONARY`` words of ``LONG`` bytes; longer
words are merged with a heap (``merge_long``), as folding them would be quadratic in their length.

Defined results: null and empty texts have no ids; texts are encoded whole, of any length; no special tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotate, bounded, let, stage

#: Words in the broadcast dictionary at most; bytes of the longest word that is folded (a power of two).
DICTIONARY, LONG = 3 << 18, 64
#: Hash buckets and slots of the literal map; bits of an id.
SHIFTS, SLOTS, _BITS = 1 << 15, 262_139, 20
#: No rank; the first id that stands for a document's own word.
_NONE, _PLACE = 1 << 24, 1 << 31
_LONG_BITS = LONG.bit_length() - 1
#: Distinct words that a task counts before it passes the counts on.
_COUNTERS = 300_000
#: Bytes of texts or ids in a batch and of those put together at once; ids that are decoded at once.
_BATCH, _PART, _AT_ONCE = 1_000_000, 250_000, 1 << 14


class Ranks:
    """A rank file and the pattern that cuts texts into words."""

    def __init__(self, path: str, pattern: str) -> None:
        self.pattern = pattern
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}

    def literals(self) -> tuple[Column, Column, Column]:
        """The rank map as constants: ids of the 256 bytes, and a hash table of the pairs of pieces that make a piece.

        The table has no collisions: the pairs of one hash bucket share a shift that leads all of them to free
        slots. A slot holds left id, right id and rank in one number.
        """
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)):
                a, b = self.ranks.get(piece[:k]), self.ranks.get(piece[k:])
                if a is not None and b is not None:
                    groups.setdefault((a * 31 + b) % SHIFTS, []).append((a, b, rank))
        shifts, slots = [0] * SHIFTS, [0] * SLOTS
        for g, pairs in sorted(groups.items(), key=lambda x: -len(x[1])):
            for shift in range(SLOTS):
                at = {(a * 7919 + b * 104_729 + shift * (a * 611_953 + b * 15_485_863)) % SLOTS for a, b, _ in pairs}
                if len(at) == len(pairs) and not any(slots[i] for i in at):
                    break
            else:
                raise ValueError("the rank map does not fit; raise SLOTS")
            shifts[g] = shift
            for a, b, rank in pairs:
                slots[(a * 7919 + b * 104_729 + shift * (a * 611_953 + b * 15_485_863)) % SLOTS] = (a << _BITS | b) << _BITS | rank
        constant = lambda x, kind: F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), kind)  # noqa: E731  Spark folds it once
        return constant([self.ranks[bytes([k])] for k in range(256)], "array<int>"), constant(shifts, "array<int>"), constant(slots, "array<bigint>")


def latin(word: bytes) -> str:
    """Bytes as a string of code points 0 to 255, the form in which words travel through Spark."""
    return word.decode("latin-1")


def encoded(word: Column, literals: tuple[Column, Column, Column]) -> Column:
    """Ids of a word (in the form of ``latin``) by folding ranked merges over its bytes.

    The state is one number per piece: the rank of it joined with its right neighbour, and its own id, which
    is also the rank it was made by, so that merged pieces need no second look.
    """
    none, (bytes_, shifts, slots) = F.lit(_NONE), literals
    id_mask = (1 << _BITS) - 1

    def fold(shift: Column, slot: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            """Piece a before b; a missing b is null, and so is what follows from it."""
            at = F.pmod(a * 7919 + b * 104_729 + F.get(shift, F.pmod(a * 31 + b, F.lit(SHIFTS)).cast("int")) * (a * 611_953 + b * 15_485_863), F.lit(SLOTS)).cast("int")
            pair = F.shiftleft(a, _BITS).bitwiseOR(b)
            rank = let(F.get(slot, at), lambda x: F.when(F.shiftright(x, _BITS) == pair, x.bitwiseAND(id_mask)).otherwise(none))
            return F.shiftleft(rank, _BITS).bitwiseOR(a)

        def merged(s: Column, low: Column, i: Column) -> Column:  # i: place of the left piece, from 0
            new = piece(low, F.get(s, i + 2).bitwiseAND(id_mask))
            changed = F.when(i > 0, F.array(piece(F.get(s, i - 1).bitwiseAND(id_mask), low), new)).otherwise(F.array(new))
            return F.flatten(F.array(F.slice(s, F.lit(1), F.greatest(i - 1, F.lit(0))), changed, F.slice(s, i + 3, F.lit(LONG))))

        def step(s: Column, _: Column) -> Column:
            first = F.array_min(F.transform(s, lambda x, k: F.shiftright(x, _BITS) * LONG + k))  # lowest rank, then leftmost
            return let(first, lambda m: F.when(m >= _NONE * LONG, s).otherwise(merged(s, F.shiftright(m, _LONG_BITS), m.bitwiseAND(LONG - 1).cast("int"))))

        def run(first: Column) -> Column:
            start = F.transform(first, lambda x, i: piece(x, F.get(first, i + 1)))
            return F.aggregate(F.slice(first, F.lit(2), F.lit(LONG)), start, step, lambda s: F.transform(s, lambda x: x.bitwiseAND(id_mask).cast("int")))

        return let(F.transform(F.split(word, ""), lambda c: F.get(bytes_, F.ascii(c)).cast("bigint")), run)

    return let(shifts, lambda x: let(slots, lambda y: fold(x, y)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of any length in O(n log n): linked pieces and a heap of ranked pairs."""
    end = list(range(1, len(word) + 1))
    left, alive = list(range(-1, len(word) - 1)), [True] * len(word)
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= len(word) or end[end[i]] != stop or not alive[end[i]]:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < len(word):
            left[stop] = i
        for a in (left[i], i):
            if a >= 0 and end[a] < len(word):
                b = end[end[a]]
                if word[a:b] in ranks:
                    heapq.heappush(heap, (ranks[word[a:b]], a, b))
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def count_words(docs: DataFrame, text: Column, pattern: str) -> DataFrame:
    """``word`` (in the form of ``latin``) and ``n`` over the whole corpus, words of up to ``LONG`` bytes."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = regex.compile(pattern).findall, Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for k in range(0, len(words), 50_000):
                some = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([latin(w.encode()) for w in some], pa.string()), pa.array([seen[w] for w in some], pa.int64())], names=["word", "n"])
            seen.clear()

        for b in batches:
            for part in bounded(b, ["text"], 4_000_000):
                for t in part.column("text").to_pylist():
                    if t:
                        seen.update(find(t))
                if len(seen) > _COUNTERS:
                    yield from out()
        yield from out()

    counts = docs.select(text.alias("text")).mapInArrow(fn, "word string, n bigint")
    return counts.where(F.length("word") <= LONG).groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """The words of the highest counts, ``most`` at most; words of one count are taken together or not at all."""
    sizes = sorted(((r.n, r["count"]) for r in counts.groupBy("n").count().toLocalIterator()), reverse=True)
    least, total = None, 0
    for n, k in sizes:
        total += k
        if total > most:
            break
        least = n
    return counts.where(F.lit(False) if least is None else F.col("n") >= least)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of each run of a length, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string of an Arrow array starts and, at last, ends, and the bytes of all."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, ends, data = column.buffers()
    return np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64), np.frombuffer(data or b"", np.uint8)


class Assembler:
    """Puts documents' ids together from the dictionary; words that are not in it leave a marked place.

    The dictionary is flat arrays, sorted by a 64-bit hash of the word: some 40 bytes a word in every worker instead of
    Python objects of five times that. Bytes are compared too; of words with one hash, one is in it and the others are
    folded beside their documents.
    """

    def __init__(self, ranks: Ranks, words: pa.Array, ids: pa.Array) -> None:
        self.ranks = ranks
        self.factors = np.random.default_rng(50).integers(0, 1 << 63, LONG, np.uint64) * np.uint64(2) + np.uint64(1)
        at, data = _strings(words)
        text = data[at[0] : at[-1]].tobytes().decode()  # in the form of ``latin``
        raw, sizes = np.frombuffer(text.encode("latin-1"), np.uint8), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        self.hashes, order = np.unique(self._hashes(starts, sizes, raw), return_index=True)
        self.sizes, self.starts = sizes[order].astype(np.int32), (np.cumsum(sizes[order]) - sizes[order]).astype(np.int32)
        self.words = raw[_spread(starts[order], sizes[order])]
        at, data = _strings(ids)
        n_ids = np.diff(at)[order] // 4
        self.n_ids, self.first_id = n_ids.astype(np.int32), (np.cumsum(n_ids) - n_ids).astype(np.int32)
        self.ids = np.append(np.frombuffer(data[at[0] : at[-1]].tobytes(), "<u4")[_spread((at[:-1][order] - at[0]) // 4, n_ids)], np.uint32(0))

    def _hashes(self, starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Of the first ``LONG`` bytes of each word; no word is empty."""
        if not len(sizes):
            return np.zeros(0, np.uint64)
        sizes = np.minimum(sizes, LONG)
        first = np.cumsum(sizes) - sizes
        terms = (raw[_spread(starts, sizes)].astype(np.uint64) + np.uint64(1)) * self.factors[_spread(np.zeros_like(sizes), sizes)]
        return np.add.reduceat(terms, first)

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First place in ``ids`` and number of ids of each word; no ids if it is not in the dictionary."""
        at, raw = _strings(words)
        starts, sizes = at[:-1], np.diff(at)
        first, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        if len(sizes) and len(self.hashes):
            h = self._hashes(starts, sizes, raw)
            slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[slot] == h) & (self.sizes[slot] == sizes))
            if len(hit):
                slot, sizes = slot[hit], sizes[hit]
                differ = raw[_spread(starts[hit], sizes)] != self.words[_spread(self.starts[slot].astype(np.int64), sizes)]
                same = ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)
                first[hit[same]], n[hit[same]] = self.first_id[slot[same]], self.n_ids[slot[same]]
        return first, n

    def places(self, documents: list[list[str]]) -> tuple[list[bytes], list[list[str]]]:
        """For documents as lists of words: little-endian ids in word order, and the words that the ids from ``_PLACE`` on stand for."""
        counts, rare = np.array([len(d) for d in documents], np.int64), [[] for _ in documents]
        coded = pa.array(itertools.chain.from_iterable(documents), pa.string()).dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        first, n = (x[code] for x in self.known(distinct))
        missing, added, sizes, own, at = np.flatnonzero(n == 0), [], [], {}, -1
        for k, doc in zip(missing.tolist(), np.searchsorted(np.cumsum(counts), missing, side="right").tolist()):
            if doc != at:
                own, at = {}, doc  # places are numbered within a document
            w = distinct[code[k]].as_py()
            x = own.get(w)
            if x is None:
                raw = w.encode()
                if len(raw) > LONG:
                    x = merge_long(raw, self.ranks.ranks)
                else:
                    x = [_PLACE + len(rare[doc])]
                    rare[doc].append(latin(raw))
                own[w] = x
            added += x
            sizes.append(len(x))
        n[missing] = sizes
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids.take(_spread(first, n), mode="clip")
        ids[_spread(ends[missing], n[missing])] = added
        ends, ids = ends[np.concatenate(([0], np.cumsum(counts)))].tolist(), ids.astype("<u4", copy=False)
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], rare


class Pieces:
    """Puts the ids of documents' own words where they belong and decodes ids: the pieces' bytes as one flat array."""

    def __init__(self, ranks: Ranks) -> None:
        piece = [b""] * (max(ranks.ranks.values(), default=-1) + 1)
        for p, r in ranks.ranks.items():
            piece[r] = p
        self.bytes, self.sizes = np.frombuffer(b"".join(piece), np.uint8), np.array([len(x) for x in piece], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def filled(self, places: list[bytes], own: list[list[list[int]]]) -> list[np.ndarray]:
        """Ids of documents, those of their own words put where they belong."""
        got, counts = np.frombuffer(b"".join(places), "<u4"), np.array([len(x) // 4 for x in places], np.int64)
        marks, n, ids = np.flatnonzero(got >= _PLACE), np.ones(len(got), np.int64), got
        if len(marks):
            lists = list(itertools.chain.from_iterable(own))
            sizes = np.array([len(x) for x in lists], np.int64)
            before = np.cumsum([0, *(len(x) for x in own)])
            which = np.repeat(before[:-1], counts)[marks] + (got[marks] - np.uint32(_PLACE))
            n[marks] = sizes[which]
            start = np.cumsum(n) - n
            ids = np.repeat(got, n)
            ids[_spread(start[marks], n[marks])] = np.array(list(itertools.chain.from_iterable(lists)), "<u4")[_spread((np.cumsum(sizes) - sizes)[which], n[marks])]
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, documents: list[np.ndarray]) -> list[bytes]:
        ids = np.concatenate(documents) if documents else np.zeros(0, "<u4")
        sizes, parts = self.sizes[ids], []
        for k in range(0, len(ids), _AT_ONCE):
            some = slice(k, k + _AT_ONCE)
            parts.append(self.bytes[_spread(self.starts[ids[some]], sizes[some])].tobytes())
        data, ends = b"".join(parts), np.concatenate(([0], np.cumsum(sizes)))
        ends = ends[np.cumsum([0, *(len(x) for x in documents)])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


def encode(docs: DataFrame, text: str, ranks: Ranks, keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or those to ``keep``), ``ids`` (little-endian unsigned 32-bit integers, as binary) and ``decoded`` bytes of every document."""
    spark = docs.sparkSession
    literals = ranks.literals()
    head = frequent(stage(count_words(docs, F.col(text), ranks.pattern), "words"))
    folded = stage(head.select("word", encoded(F.col("word"), literals).alias("ids")), "dictionary").toArrow()  # DICTIONARY rows at most
    words, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (folded.column("word"), folded.column("ids")))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32) * 4
    packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
    sent, pattern = spark.sparkContext.broadcast(Assembler(ranks, words, packed)), ranks.pattern
    pieces = spark.sparkContext.broadcast(Pieces(ranks))  # apart, as other workers fill than cut

    def cut(batch):
        find, places, rare = regex.compile(pattern).findall, [], []
        for part in bounded(batch, ["text"], _PART):
            got = sent.value.places([find(t) if t else [] for t in part.column("text").to_pylist()])
            places += got[0]
            rare += got[1]
        return {"places": places, "rare": rare}

    def fill(batch):
        ids, decoded = [], []
        for part in bounded(batch, ["places", "rare_ids"], _PART):
            got = pieces.value.filled(part.column("places").to_pylist(), part.column("rare_ids").to_pylist())
            ids += [x.tobytes() for x in got]
            decoded += pieces.value.decode(got)
        return {"ids": ids, "decoded": decoded}

    first = annotate(docs, {"text": F.col(text)}, cut, "places binary, rare array<string>", keep, _BATCH)
    folded = first.select("row", "places", F.transform("rare", lambda w: encoded(w, literals)).alias("rare_ids"))
    got = annotate(folded, {"places": F.col("places"), "rare_ids": F.col("rare_ids")}, fill, "ids binary, decoded binary", most=_BATCH)
    return got.select(F.col("row.row").alias("row"), "ids", "decoded")


def report(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """The contract's row per document."""
    got = encode(docs, "text", ranks, ["doc_id"])
    return got.select("row.doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
