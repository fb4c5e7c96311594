"""Language identification with bit-sliced Bloom filters of character n-grams.

For every language the n-grams common among its training texts are put into one Bloom filter. The filters
are stored bit-sliced: one word per bit position holds that bit of all languages, so k reads and an AND
return the mask of all languages that contain an n-gram. A document counts, per language, the n-grams whose
mask has the language's bit (with repeats); the counts are corrected by each filter's own rate of false
positives, and the largest share decides.

The filter's size is fixed by ``BITS`` and the number of languages; it is learned from at most about
``SAMPLE`` texts per language, chosen by the hash of their text and id. Predictions see texts alone.

Defined results: ``und`` with score 0 for null texts and texts without a letter; equal shares go to the
language that sorts first; rows with a null language are not learned from; without training rows everything
is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotate, bounded

GRAMS = (3, 4)
#: Positions per filter, hash functions, training texts per language (about), n-grams per language at most.
BITS, HASHES, SAMPLE, TOP = 1 << 20, 3, 1_500, 30_000
#: An n-gram belongs to a language if at least this share of its training texts has it, and two of them.
SHARE = 0.01
MAX_LANGUAGES = 1_024
_P = np.uint64(0x100000001B3)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of anything but letters are one space, one at each end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes[codes >= 128]
    letter = ((codes >= 97) & (codes <= 122)).astype(bool)
    if len(high):
        known = np.unique(high)
        letters = known[[chr(c).isalpha() for c in known]]
        letter |= np.isin(codes, letters)
    codes = np.where(letter, codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))].astype(np.uint64)


def grams(text: str | None) -> np.ndarray:
    """Hashes of all n-grams with a letter, repeats included; empty if the text has no letter."""
    codes = _codes(text) if text else np.empty(0, np.uint64)
    if len(codes) < 3:
        return np.empty(0, np.uint64)
    out = []
    for n in GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, np.uint64(n))
            for k in range(n):
                h = h * _P + codes[k : len(codes) - n + 1 + k]
            out.append(h)
    return _finish(np.concatenate(out))


class BitSlicedFilter:
    """``rows[p]`` holds bit p of every language's filter, 64 languages to a word."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.rows = np.zeros((BITS, max(1, -(-len(languages) // 64))), np.uint64)

    @staticmethod
    def positions(h: np.ndarray, k: int) -> np.ndarray:
        step = (h >> np.uint64(32)) | np.uint64(1)
        return ((h + np.uint64(k) * step) & np.uint64(BITS - 1)).astype(np.int64)

    def add(self, language: int, h: np.ndarray) -> None:
        bit = np.uint64(1) << np.uint64(language % 64)
        for k in range(HASHES):
            self.rows[np.unique(self.positions(h, k)), language // 64] |= bit

    def close(self) -> None:
        """Measures every language's rate of false positives from its share of set bits."""
        fill = [float(((self.rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(self.languages))]
        self.false_rate = np.array(fill) ** HASHES

    def counts(self, h: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams its filter contains."""
        masks = self.rows[self.positions(h, 0)]
        for k in range(1, HASHES):
            masks &= self.rows[self.positions(h, k)]
        out = np.empty(len(self.languages))
        for w in range(masks.shape[1]):
            held, times = np.unique(masks[:, w], return_counts=True)  # few different masks
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                out[i] = times[(held >> np.uint64(i % 64)) & np.uint64(1) == 1].sum()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        h = grams(text)
        if not len(h) or not self.languages:
            return "und", 0.0
        share = np.clip((self.counts(h) / len(h) - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(np.argmax(share))
        rest = np.delete(share, best)
        second = rest.max() if len(rest) else 0.0
        top = float(share[best])
        return self.languages[best], float(top / (top + second)) if top > 0 else 0.0


def _text_column(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def fit(labelled: DataFrame) -> BitSlicedFilter:
    """Filters from ``labelled`` (text, lang)."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    model = BitSlicedFilter(languages)
    if languages:
        share = spark.createDataFrame([(k, int(min(1.0, SAMPLE / n) * 2**31)) for k, n in sizes.items()], "lang string, upto bigint")
        some = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("text", "id"), F.lit(2**31)) < F.col("upto")).select("lang", "text")

        def fn(batches):
            for b in batches:
                for part in bounded(b, ["text"], 1_000_000):
                    langs, gs = [], []
                    for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                        h = np.unique(grams(text))
                        langs += [lang] * len(h)
                        gs.append(h.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(gs) if gs else np.empty(0, np.int64))], names=["lang", "gram"])

        used = {r.lang: r["count"] for r in some.groupBy("lang").count().collect()}
        need = spark.createDataFrame([(k, float(max(2.0, SHARE * n)) if n > 3 else 1.0) for k, n in used.items()], "lang string, need double")
        held = (some.mapInArrow(fn, "lang string, gram bigint").groupBy("lang", "gram").count()
                .join(F.broadcast(need), "lang").where(F.col("count") >= F.col("need")))
        found: dict[str, list[tuple[int, int]]] = {}
        for r in held.select("lang", "gram", "count").toLocalIterator():
            found.setdefault(r.lang, []).append((-r["count"], r.gram))
        for k, lang in enumerate(languages):
            top = sorted(found.get(lang, []))[:TOP]
            model.add(k, np.array([g for _, g in top], np.int64).view(np.uint64))
    model.close()
    return model


def identify(docs: DataFrame, model: BitSlicedFilter, text: Column) -> DataFrame:
    """``row``, ``lang_pred`` and ``score`` for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch):
        got = [sent.value.predict(t) for t in _text_column(batch.column("text"))]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return annotate(docs, {"text": text}, fn, "lang_pred string, score double")
