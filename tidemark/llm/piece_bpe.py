"""SentencePiece BPE: encoding by vectorised merge rounds over flat symbol arrays, and decoding.

The model file is read on the driver (``PieceModel``) and broadcast; its size does not depend on the data. Documents
are never shuffled: a task cuts the texts of a batch of at most ``BATCH`` bytes into words, merges the distinct ones
that its worker has not met yet, and puts every document's ids together by one gather.

* A *word* is a stretch that no merge can cross: no piece of the model joins its end to what follows. Spaces only
  begin pieces, and characters that occur in no piece of two characters or more stand alone.
* ``merge_rounds`` holds the symbols of all words in one flat array. A round takes the lowest pair rank of every word
  (segmented minimum), merges all its occurrences at once, leftmost first where they overlap, compacts the arrays and
  looks up the ranks of the changed pairs alone. Words without a ranked pair leave. Where a merged piece could make a
  pair that is due before its rank's other occurrences (``early``; runs of spaces have such pieces), the word merges
  its leftmost occurrence alone in that round, so the result is always that of one merge at a time.
* Words of more than ``LONG`` characters (runs of thousands of letters without a space) would need a round per rank:
  ``merge_long`` merges them with a heap in O(n log n), to the same result.
* Symbols that are no piece fall back to the ids of their UTF-8 bytes, or to the unknown id in models without bytes.

Models of type BPE with identity normalisation are supported; others are refused when they are read.

Defined results: null and empty texts have no ids and decode to the empty text; texts are encoded whole, of any
length; repeated rows give repeated results; an empty table gives an empty table. The row travels inside one struct,
so columns of any name survive.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotate, bounded

#: Bytes of text that a worker takes at a time; characters of the longest word of the rounds; words that a worker remembers.
BATCH, LONG, REMEMBERED = 1_000_000, 256, 200_000
SPACE = "▁"
_NONE = np.int32(2**31 - 1)
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class _Numbers(dict):
    """Numbers words as they come; ``new`` are those that came since it was emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class PieceModel:
    """Pieces, ranks of their pairs and flags of a model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces: list[str] = []
        kinds, scores = [], []
        for _, raw in (x for x in message if x[0] == 1):
            piece = dict(_fields(raw))
            self.pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, _NORMAL))
        trainer, normaliser = (dict(f for _, raw in message if _ == k for f in _fields(raw)) for k in (2, 3))
        if trainer.get(3, 1) != 2 or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0) or {_USER, _UNUSED} & set(kinds):
            raise ValueError("only BPE models with identity normalisation, without user-defined and unused pieces")
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _BYTE} if trainer.get(35) else {}
        surface = trainer[44].decode() if 44 in trainer else " ⁇ "
        self.surfaces = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else surface.encode() if k == _UNKNOWN else p.replace(SPACE, " ").encode()
                         for p, k in zip(self.pieces, kinds)]
        self._symbols(kinds, scores)
        self._start()

    def _symbols(self, kinds: list[int], scores: list[float]) -> None:
        """Numbers of the symbols (pieces, then further characters of pieces) and a hash table of the ranked pairs."""
        ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == _NORMAL}
        joined = {p: i for p, i in ids.items() if len(p) > 1}
        if any(b == SPACE != a for p in joined for a, b in zip(p, p[1:])):
            raise ValueError("only models whose pieces hold spaces at their start")
        chars = sorted({c for p in joined for c in p})
        symbols = dict(ids)
        for c in chars:
            symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.count = max(symbols.values()) + 1
        self.codes = {c: symbols[c] for c in {c for c in symbols if len(c) == 1}}
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in joined.values()}, reverse=True))}
        rank = {p: order[scores[i]] for p, i in joined.items()}
        pairs = [(symbols[p[:k]], symbols[p[k:]], rank[p], i) for p, i in joined.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.pairs = {(a, b): (r, i) for a, b, r, i in pairs}
        # Ranks of which a merged piece can begin or end a piece that is due at the same time or sooner.
        early = {rank[q] for p in joined for q in (*(p[:k] for k in range(2, len(p))), *(p[k:] for k in range(1, len(p) - 1))) if q in rank and rank[q] >= rank[p]}
        self.early = np.zeros(len(order) + 1, bool)
        self.early[list(early)] = True
        bits = max(10, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        keys, found = np.full(1 << bits, -1, np.int64), np.zeros((2, 1 << bits), np.int32)
        key = np.array([a * self.count + b for a, b, _, _ in pairs], np.int64)
        for k, h, (_, _, r, i) in zip(key.tolist(), self._slot(key).tolist(), pairs):
            while keys[h] >= 0:
                h = (h + 1) & (len(keys) - 1)
            keys[h], found[0, h], found[1, h] = k, r, i
        self.keys, self.ranks, self.made = keys, found[0], found[1]
        joining = "".join(c for c in chars if c != SPACE)
        inside = f"[{re.escape(joining)}]" if joining else "(?!)"
        self.words = re.compile(f"{SPACE}*{inside}+|{SPACE}+|(?s:.)")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        self._table = np.full(0x110000, -1, np.int32)
        for c, s in self.codes.items():
            self._table[ord(c)] = s
        spelt = {s: self.fallback(c) for c, s in self.codes.items() if s >= len(self.pieces)}
        ids = [spelt.get(s, [s]) for s in range(self.count)]
        self._spread = np.array([len(x) for x in ids])
        self._from = np.cumsum(self._spread) - self._spread
        self._spelling = np.array([x for own in ids for x in own], np.int32)
        self._forget()

    def _forget(self) -> None:
        """An empty memory of words: their numbers, and their ids end to end."""
        self._known = _Numbers()
        self._ids, self._starts, self._sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; ``_NONE`` where they make no piece."""
        key = a.astype(np.int64) * self.count + b
        at = self._slot(key)
        got = self.keys[at]
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got[open_] = self.keys[at[open_]]
            open_ = open_[(got[open_] != key[open_]) & (got[open_] >= 0)]
        hit = got == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes[x] for x in char.encode()] if self.bytes else [self.unknown]

    def merge_rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of words that lie end to end in ``symbols``, none of them empty, and their new sizes."""
        words = np.arange(len(sizes))
        rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)
        ends = np.cumsum(sizes)
        inner = np.ones(len(symbols), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        rank[at], made[at] = self.lookup(symbols[at], symbols[at + 1])
        finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(words):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            if done.any():
                gone = np.repeat(done, sizes)
                finished.append((words[done], sizes[done], symbols[gone]))
                stay = ~gone
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                words, sizes, low = words[~done], sizes[~done], low[~done]
                if not len(words):
                    break
                starts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            word = np.searchsorted(starts, at, "right") - 1
            k = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, k, 0))
            take = (k - run) & 1 == 0
            one = self.early[low]
            if one.any():
                take &= ~one[word] | (np.diff(word, prepend=-1) != 0)
            at, word = at[take], word[take]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, rank, made = symbols[keep], rank[keep], made[keep]
            sizes = sizes - np.bincount(word, minlength=len(sizes))
            at = at - np.arange(len(at))  # each merge before this one took a place
            ends = np.cumsum(sizes)
            right = at + 1 < ends[word]
            rank[at[~right]] = _NONE
            left = at > ends[word] - sizes[word]
            changed = np.concatenate((at[right], at[left] - 1))
            rank[changed], made[changed] = self.lookup(symbols[changed], symbols[changed + 1])
        sizes = np.zeros(sum(len(w) for w, _, _ in finished), np.int64)
        for w, n, _ in finished:
            sizes[w] = n
        starts, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.int32)
        for w, n, s in finished:
            out[np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(len(s))] = s
        return out, sizes

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long word: linked symbols and a heap of ranked pairs, leftmost first."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (found := self.pairs.get((symbols[i], symbols[after[i]]))):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[after[i]], found[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j], after[i] = piece, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [s for s in symbols if s >= 0]

    def _learn(self, words: list[str]) -> None:
        """Adds words, which have the next numbers, to the memory."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        is_short = (lengths <= LONG) & ((lengths > 1) | np.fromiter((w in self.codes for w in words), bool, len(words)))
        rest = [w for w, x in zip(words, is_short.tolist()) if not x]
        parts, counts = [], np.zeros(0, np.int64)
        if is_short.any():
            codes = np.frombuffer("".join(w for w, x in zip(words, is_short.tolist()) if x).encode("utf-32-le"), "<u4")
            symbols, counts = self.merge_rounds(self._table[codes], lengths[is_short])
            spread = self._spread[symbols]
            counts = np.add.reduceat(spread, np.cumsum(counts) - counts)
            parts.append(self._spell(symbols))
        for w in rest:  # long words, and characters that occur in no piece
            parts.append(self._spell(np.array(self.merge_long([self.codes[c] for c in w]))) if len(w) > 1 else np.array(self.fallback(w), np.int32))
        sizes = np.zeros(len(words), np.int64)
        sizes[is_short], sizes[~is_short] = counts, [len(p) for p in parts[len(parts) - len(rest):]]
        starts = np.zeros(len(words), np.int64)
        starts[is_short] = np.cumsum(counts) - counts
        starts[~is_short] = counts.sum() + np.cumsum(sizes[~is_short]) - sizes[~is_short]
        self._starts, self._sizes = np.concatenate((self._starts, len(self._ids) + starts)), np.concatenate((self._sizes, sizes))
        self._ids = np.concatenate((self._ids, *parts))

    def _spell(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols: their own, or those of a character that is no piece."""
        counts = self._spread[symbols]
        if (counts == 1).all() and (len(symbols) == 0 or symbols.max() < len(self.pieces)):
            return symbols.astype(np.int32)
        ends = np.cumsum(counts)
        return self._spelling[np.repeat(self._from[symbols] - (ends - counts), counts) + np.arange(ends[-1])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text ends."""
        if len(self._known) > REMEMBERED:
            self._forget()
        counts, flat = [], []
        for t in texts:
            got = self.words.findall(self.prefix + t.replace(" ", SPACE)) if t else []
            counts.append(len(got))
            flat += got
        at = np.fromiter(map(self._known.__getitem__, flat), np.int64, len(flat))
        if self._known.new:
            self._learn(self._known.new)
            self._known.new = []
        sizes = self._sizes[at]
        ends = np.cumsum(sizes)
        ids = self._ids[np.repeat(self._starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[np.cumsum(counts)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces end to end without the space put before the text; bytes that are no UTF-8 become U+FFFD each."""
        raw = b"".join(map(self.surfaces.__getitem__, ids))
        text = raw.decode("utf-8", "tidemark_byte")
        if self.prefix and text.startswith(" ") and (first := next((i for i in ids if self.surfaces[i]), None)) is not None:
            return text[1:] if self.pieces[first].startswith(SPACE) else text
        return text


codecs.register_error("tidemark_byte", lambda e: ("�", e.start + 1))


def encode(docs: DataFrame, text: str, model: PieceModel, keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or those to ``keep``), ``ids`` (array of int) and ``decoded`` text of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> dict:
        ids, ends, decoded = [], [], []
        own, total = sent.value, 0
        for part in bounded(batch, ["text"], BATCH):
            flat, stops = own.encode(part.column("text").to_pylist())
            listed, begin = flat.tolist(), 0
            for stop in stops.tolist():
                decoded.append(own.decode(listed[begin:stop]))
                begin = stop
            ids.append(flat)
            ends.append(stops + total)
            total += len(flat)
        offsets = np.concatenate(([0], *ends)).astype(np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))), "decoded": decoded}

    return annotate(docs, {"text": F.col(text)}, fn, "ids array<int>, decoded string", keep)


def report(docs: DataFrame, model: PieceModel) -> DataFrame:
    """The contract's row per document."""
    got = encode(docs, "text", model, ["doc_id"])
    return got.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
