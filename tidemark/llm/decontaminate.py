"""Benchmark decontamination with a broadcast set of hashed n-grams.

Benchmark texts are split into words (A-Z lower-cased; every ASCII byte other than letters and digits
separates) and cut into windows of ``n`` consecutive words; an item of fewer words, but not none, is one
window. The windows' hashes are broadcast; tasks scan the words of whole documents, look every window of
words up and verify hits word by word. Documents never leave their task, so nothing is shuffled.

The broadcast is bounded: items are packed into blocks of at most ``block_bytes`` of text, and documents
are scanned once per block, with the hits so far carried along.

Defined results: null and wordless texts have no words and no hit; repeated items count once (by id); an
item with a null id marks hits but is not named; repeated documents are scanned each for themselves; an
empty benchmark leaves every document as it is; columns of any other name are kept.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BYTES, annotate, stage, utf8, words_of

WINDOW = 10
BLOCK_BYTES = 32 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class NgramSet:
    """Windows of one block of items: sorted 64-bit hashes by window length, and the exact windows behind them."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        exact: dict[int, dict[bytes, set]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            length = min(n, len(ids))
            for k in range(len(ids) - length + 1 if length else 0):
                exact.setdefault(length, {}).setdefault(ids[k : k + length].tobytes(), set()).add(item)
        self.windows = {length: {w: tuple(x) for w, x in found.items()} for length, found in exact.items()}
        self.hashes = {length: np.unique(self._hash(np.frombuffer(b"".join(found), np.int64).reshape(-1, length)))
                       for length, found in exact.items()}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            h = (h ^ rows[:, k].astype(np.uint64)) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Starts and ends (exclusive) of verified windows, one row each, and the items they come from."""
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        spans, items = [], set()
        gaps = np.concatenate(([0], np.cumsum(ids == 0)))
        for length, exact in self.windows.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(gaps[length:] == gaps[:-length])  # windows of benchmark words only
            if not len(at):
                continue
            rows = ids[at[:, None] + np.arange(length)]
            h, pool = self._hash(rows), self.hashes[length]
            k = np.minimum(np.searchsorted(pool, h), len(pool) - 1)
            for i in np.flatnonzero(pool[k] == h):
                found = exact.get(rows[i].tobytes())  # the words themselves decide
                if found is not None:
                    spans.append((at[i], at[i] + length))
                    items.update(x for x in found if x is not None)
        return np.array(spans, np.int64).reshape(-1, 2), items


def hit_words(spans, n_words: int) -> np.ndarray:
    """For every word, whether it lies inside a span."""
    edges = np.zeros(n_words + 1, np.int64)
    s = np.asarray(spans, np.int64).reshape(-1, 2)
    np.add.at(edges, s[:, 0], 1)
    np.add.at(edges, s[:, 1], -1)
    return np.cumsum(edges)[:n_words] > 0


def _merged(spans: np.ndarray) -> list[int]:
    out: list[int] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return [int(x) for x in out]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Items as (id, text) lists of bounded size; items arrive one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).distinct()
    for item, text in rows.toLocalIterator():
        if block and size + len(text or b"") > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, None if text is None else bytes(text)))
        size += len(text or b"")
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the document), ``n_words``, ``spans`` (word starts and ends of merged hits, in turn) and ``item_ids``."""
    spark = docs.sparkSession
    found = None
    for block in benchmark_blocks(benchmark, block_bytes):
        if found is not None:
            found = stage(found, "passages")
        grams = spark.sparkContext.broadcast(NgramSet(block, n))
        carry = found if found is not None else docs.select(
            F.struct("*").alias("row"), F.lit(None).cast("array<int>").alias("spans"),
            F.lit(None).cast("array<string>").alias("item_ids"))
        found = _scan(carry, grams, text)
    if found is None:
        found = _scan(docs.select(F.struct("*").alias("row"), F.lit(None).cast("array<int>").alias("spans"),
                                  F.lit(None).cast("array<string>").alias("item_ids")),
                      spark.sparkContext.broadcast(NgramSet([], n)), text)
    return found


def _scan(carry: DataFrame, grams, text: str) -> DataFrame:
    def fn(batch):
        texts, spans, items = utf8(batch.column("text")), batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist()
        out = {"n_words": [], "spans": [], "item_ids": []}
        for t, s, i in zip(texts, spans, items):
            words = words_of(t)
            new, named = grams.value.scan(words)
            if len(new) or s:
                new = np.concatenate((new, np.array(s or [], np.int64).reshape(-1, 2)))
            out["n_words"].append(len(words))
            out["spans"].append(_merged(new))
            out["item_ids"].append(sorted(named.union(i or ())))
        return out

    got = annotate(carry, {"text": F.col("row").getField(text), "spans": F.col("spans"), "item_ids": F.col("item_ids")},
                   fn, "n_words bigint, spans array<int>, item_ids array<string>")
    return got.select(F.col("row.row").alias("row"), "n_words", "spans", "item_ids")


def cut_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(WORD_BYTES))]
    out, end = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text: str = "text",
                  n: int = WINDOW) -> DataFrame:
    """Documents without benchmark passages, with the columns of ``docs``.

    ``document`` removes every document with a hit, ``span`` removes the hit passages from the texts.
    """
    found = find_passages(docs, benchmark, text, n)
    if mode == "document":
        return found.where(F.size("spans") == 0).select("row.*")
    if mode != "span":
        raise ValueError(f"mode is document or span, not {mode}")

    def fn(batch):
        pairs = zip(utf8(batch.column("text")), batch.column("spans").to_pylist())
        return {"cut": [None if t is None else cut_spans(t, s).decode() for t, s in pairs]}

    cut = annotate(found, {"text": F.col("row").getField(text), "spans": F.col("spans")}, fn, "cut string")
    return cut.select(F.col("row.row").alias("row"), "cut").select(
        *[F.col("cut").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row per document."""
    found = find_passages(docs.select("doc_id", "text"), benchmark)

    def fn(batch):
        out = {"n_hit": [], "items_sha256": []}
        for s, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            out["n_hit"].append(sum(s[1::2]) - sum(s[::2]))
            out["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
        return out

    slim = found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "spans", "item_ids")
    got = annotate(slim, {"spans": F.col("spans"), "items": F.col("item_ids")}, fn, "n_hit bigint, items_sha256 string")
    return got.select("row.doc_id", "row.n_words", "n_hit", F.size("row.item_ids").cast("long").alias("n_items"),
                      "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
