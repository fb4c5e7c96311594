"""Exact dedup against a minimal perfect hash of historical digests.

``build_index`` keeps one entry per distinct text of a history: its SHA-256 digest, the winner's id and the
group's size. Digests are dealt to buckets of bounded size by hash; each bucket gets a minimal
perfect hash of its own (levelled collision-free bit vectors, ranked), whose slots hold the full digests and
the winners. ``lookup`` groups the digests of a batch first, sends each distinct digest to its bucket once,
computes its slot and compares all 32 bytes: members are repeats of the slot's winner, nonmembers are groups
of their own. No task sees more than one bucket, and buckets are as many as the larger of the history and the
batch needs; a digest with a third of all rows is one row after the
map-side combine.

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` became one space; null counts as
empty. Of equal texts the row with the smallest id wins; a null id wins only over nulls. Repeated rows (same
id and text) all name the same winner; ``distinct_documents`` keeps one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Distinct digests per bucket, about: 32 + 8 + 8 bytes each in one index row.
BUCKET_KEYS = 8_192
SPACES = r"[\x20\x09-\x0D]+"
GROUPS = "digest binary, keep_id bigint, group_size bigint, member boolean"
INDEX = "bucket int, n bigint, levels array<binary>, rest binary, digests binary, winners binary, null_winners binary, sizes binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """64-bit hash of digests (rows of four 64-bit words) for one level."""
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    h = np.full(len(words), seed)
    for k in range(4):
        h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests.

    Level by level, keys that meet no other key at their bit set it; the rest go to the next level. A key's
    slot is the number of set bits before its own. ``rest`` holds what 40 levels did not place.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.before = np.concatenate(([0], np.cumsum([int(x.sum()) for x in levels]))).astype(np.int64)
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels = []
        while len(words) and len(levels) < 40:
            at = _mix(words, len(levels)) % np.uint64(2 * len(words) + 1)
            alone = np.bincount(at.astype(np.int64), minlength=2 * len(words) + 1) == 1
            levels.append(alone)
            words = words[~alone[at.astype(np.int64)]]
        return cls([x.astype(np.int64) for x in levels], words)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for keys that were not there when it was built."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for k, bits in enumerate(self.levels):
            at = (_mix(words[left], k) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at] == 1
            out[left[here]] = self.before[k] + self.ranks[k][at[here]]
            left = left[~here]
        if len(self.rest):
            place = {r.tobytes(): self.before[-1] + j for j, r in enumerate(self.rest)}
            for i in left:
                out[i] = place.get(words[i].tobytes(), -1)
        return out


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in digests), "<u8").reshape(-1, 4)


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def grouped(keys: DataFrame) -> DataFrame:
    """Distinct digests of ``keys`` (id, digest) with the smallest id and the number of rows."""
    return keys.groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("size"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of the history's digest groups (``digest, winner, size``)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = _words(pdf["digest"])
        mph = PerfectHash.build(words)
        slot = mph.slots(words)
        table, winners, nulls, sizes = np.empty_like(words), np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8), np.zeros(len(words), np.int64)
        table[slot] = words
        winners[slot] = pdf["winner"].fillna(0).astype("int64").to_numpy()
        nulls[slot] = pdf["winner"].isna().to_numpy()
        sizes[slot] = pdf["size"].astype("int64").to_numpy()
        return pd.DataFrame([{
            "bucket": int(pdf["bucket"].iloc[0]), "n": len(words),
            "levels": [len(x).to_bytes(4, "little") + np.packbits(x.astype(np.uint8)).tobytes() for x in mph.levels],
            "rest": mph.rest.tobytes(), "digests": table.tobytes(), "winners": winners.tobytes(),
            "null_winners": nulls.tobytes(), "sizes": sizes.tobytes()}])

    return history.withColumn("bucket", _bucket(F.col("digest"), buckets)).groupBy("bucket").applyInPandas(build, INDEX)


def _restore(row) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    levels = []
    for x in row.levels:
        x = bytes(x)
        levels.append(np.unpackbits(np.frombuffer(x[4:], np.uint8))[: int.from_bytes(x[:4], "little")].astype(np.int64))
    return (PerfectHash(levels, np.frombuffer(bytes(row.rest), "<u8").reshape(-1, 4)),
            np.frombuffer(bytes(row.digests), "<u8").reshape(-1, 4), np.frombuffer(bytes(row.winners), np.int64),
            np.frombuffer(bytes(row.null_winners), np.uint8), np.frombuffer(bytes(row.sizes), np.int64))


def lookup(batch: DataFrame, index: DataFrame, buckets: int, emit_history: bool = True) -> DataFrame:
    """Digest groups of ``batch`` (``digest, winner, size``) resolved against ``index``.

    Members get the history's winner and both sizes together, nonmembers keep their own. With
    ``emit_history``, groups that only the history has come out too.
    """

    def probe(new: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        parts = []
        left = np.arange(len(new))
        words = _words(new["digest"]) if len(new) else np.empty((0, 4), np.uint64)
        own = new["winner"].astype("Int64") if len(new) else None
        size = new["size"].astype("int64").to_numpy() if len(new) else np.empty(0, np.int64)
        for row in shards.itertuples():
            mph, table, winners, nulls, sizes = _restore(row)
            total = sizes.copy()
            if len(left):
                slot = mph.slots(words[left])
                same = (slot >= 0) & (table[np.maximum(slot, 0)] == words[left]).all(axis=1)  # all 32 bytes
                total[slot[same]] += size[left[same]]
                hit = np.zeros(len(table), bool)
                hit[slot[same]] = True
                left = left[~same]
            else:
                hit = np.zeros(len(table), bool)
            take = np.arange(len(table)) if emit_history else np.flatnonzero(hit)
            keep = pd.array(winners[take], dtype="Int64")
            keep[nulls[take] == 1] = pd.NA
            parts.append(pd.DataFrame({"digest": [table[i].tobytes() for i in take], "keep_id": keep,
                                       "group_size": total[take], "member": hit[take]}))
        if len(left):
            parts.append(pd.DataFrame({"digest": [words[i].tobytes() for i in left], "keep_id": own.iloc[left].array,
                                       "group_size": size[left], "member": False}))
        return pd.concat(parts) if parts else pd.DataFrame({"digest": [], "keep_id": [], "group_size": [], "member": []})

    dealt = batch.withColumn("bucket", _bucket(F.col("digest"), buckets))
    return dealt.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, GROUPS)


def bucket_count(*groups: DataFrame) -> int:
    """Buckets for the largest of some tables of digest groups."""
    return max(1, *(-(-g.count() // BUCKET_KEYS) for g in groups))


def resolve(keys: DataFrame) -> DataFrame:
    """Groups of a whole corpus of (id, digest): the earlier half by id is the history, the rest is looked up in it.

    The cut is about the median of the ids, so a history's winner is never later than a batch's. Rows without an
    id belong to the batch. Both sides' digests count for the buckets, as one id may be that of many rows.
    """
    cut = keys.agg(F.percentile_approx("id", 0.5).alias("cut")).first().cut
    early = F.coalesce(F.col("id") <= F.lit(cut), F.lit(False))
    history = stage(grouped(keys.where(early)), "history")
    batch = stage(grouped(keys.where(~early)), "batch")
    buckets = bucket_count(history, batch)
    index = stage(build_index(history, buckets), "index")
    return stage(lookup(batch, index, buckets), "groups")


def mark(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    keys = stage(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text)).alias("digest")), "keys")
    out = keys.join(resolve(keys), "digest")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row of each group of equal texts: that of the smallest id."""
    keys = stage(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text)).alias("digest")), "keys")
    winners = resolve(keys).select(F.col("digest").alias("w_digest"), F.col("keep_id").alias("w_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text)).alias("digest"))
    # id and digest together deal a large group's rows over all tasks
    won = rows.join(winners, (F.col("digest") == F.col("w_digest")) & F.col("id").eqNullSafe(F.col("w_id")), "left_semi")
    return won.dropDuplicates(["id", "digest"]).select("row.*")
