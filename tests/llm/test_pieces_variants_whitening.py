"""Operators 11 to 13 against the tokenizer library, plain loops and dense linear algebra."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import piece_bpe, variants, whitening
from tidemark.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceModel(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = ["", " ", "   ", "a", "\x00", "▁", "a▁b ▁", "  x  y \n\n z ", " " * 40 + "x" + " " * 33, "日本語 한국어 😀😀", "aaaaaaaa" * 20, "�▁", "x" * 5000,
       " " * 3000, "é" * 700, "ab" * 4000, "the cat\tsat\r\n on the mat", "ü" * 300 + " " * 300 + "in" * 300]


def test_pieces_equal_the_library(model, library):
    rng = random.Random(4)
    letters = [c for c in model.codes if c != piece_bpe.SPACE] + list("     \n\tabcdeéÀß中😀")
    texts = [*ODD, *["".join(rng.choices(letters, k=rng.randint(1, 200))) for _ in range(150)],
             *["".join(rng.choices("abet ▁in", k=rng.randint(1, 600))) for _ in range(150)]]
    ids, ends = model.encode(texts)
    begin = 0
    for t, end in zip(texts, ends.tolist()):
        own = ids[begin:end].tolist()
        assert own == library.encode(t), t[:50]
        assert model.decode(own) == library.decode(own), t[:50]
        begin = end


def test_rounds_equal_the_heap(model):
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choices("thenigvar", k=rng.randint(2, 80)))
        symbols = [model.codes[c] for c in word]
        rounds, sizes = model.merge_rounds(np.array(symbols, np.int32), np.array([len(word)]))
        assert rounds.tolist() == model.merge_long(symbols) and sizes.tolist() == [len(rounds)]


def test_memory_of_words_is_bounded(model, monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 10)
    for k in range(20):
        t = " ".join(f"word{k}{j}" for j in range(30))
        assert model.encode([t])[0].tolist() == library.encode(t)
        assert len(model._known) <= 400


def test_decode_of_any_ids(model, library):
    rng = random.Random(6)
    for _ in range(200):
        ids = [rng.randrange(model.pieces.__len__()) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(1, 20))]
        assert model.decode(ids) == library.decode(ids), ids


def test_piece_query(spark, tmp_path, library):
    texts = [None, *ODD, ODD[-1], "word " * 30000]
    spark.createDataFrame([(k, t, "x", b"y") for k, t in enumerate(texts)], "doc_id bigint, text string, ids string, `row` binary").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op11_piece_bpe"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[k][1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))), (t or "")[:50]


def test_piece_columns_survive(spark, model):
    docs = spark.createDataFrame([(1, "a b", "own"), (1, "a b", "own"), (None, None, None)], "doc_id bigint, text string, ids string")
    got = piece_bpe.encode(docs, "text", model).select("row.*", "decoded").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a b", "own", "a b"), (1, "a b", "own", "a b"), (None, None, None, "")]
    assert piece_bpe.encode(docs.limit(0), "text", model).count() == 0


def slow_variants(docs):
    """Rows of the contract by comparing all words with all."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in found.items() if vs}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c, len(found[w]), words[form[w]] if w in form else None) for w, c in words.items())


def rows_of(got):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect())


@pytest.mark.parametrize("letters", ["ab", "abcÀÿxyz"])
def test_variants_of_random_words(spark, tmp_path, letters):
    rng = random.Random(len(letters))
    pool = ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(120)]
    pool += [w[:2] + rng.choice(letters) + w[3:] for w in pool] + [w + rng.choice(letters) for w in pool] + ["a" * k for k in range(4, 30)]
    pool += ["lang" * 200, "lang" * 200 + "e", "Straßen", "straßen", "STRASSEN"]
    weights = [1 + 40 * (rng.random() < 0.2) for _ in pool]
    docs = [(k, " ".join(rng.choices(pool, weights, k=200)) + " 12 ... x") for k in range(30)]
    docs += [(31, None), (32, ""), (None, "nullid nullid nullid")] + [(33, " ".join(pool))] * 3  # a row three times
    spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "text AS word", "1 AS n").write.parquet(str(tmp_path / "documents.parquet"))
    want = slow_variants(docs)
    assert len(want) > 100 and any(r[1] for r in want)
    assert rows_of(QUERIES["op12_spelling_variants"](spark, str(tmp_path))) == want


def test_variants_follow_chains_and_break_ties(spark):
    words = spark.createDataFrame([("abcde", 3), ("abcdef", 6), ("abcdefg", 12), ("abcdefgh", 24), ("zzzzb", 50), ("zzzza", 50), ("zzzzz", 25), ("alone", 9)], "word string, n bigint")
    got = {r[0]: r for r in rows_of(variants.variants(words))}
    assert [got[w][2] for w in ("abcde", "abcdef", "abcdefg", "abcdefgh")] == ["abcdefgh"] * 4
    assert got["zzzzz"][1:] == ("zzzza", "zzzza", 25, 2, 50) and got["zzzza"][1:] == (None, "zzzza", 50, 2, None)
    assert got["alone"][1:] == (None, "alone", 9, 0, None)
    assert variants.variants(words.limit(0)).count() == 0


def dense(vectors):
    """Deviations, whitened rows, shares of the fit by dense eigenvectors."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    z = u - s / n
    values, q = np.linalg.eigh(z.T @ z / n)
    values, q = values[::-1], q[:, ::-1]
    top = [k for k in range(min(4, len(values))) if values[k] > 1e-11 * values.sum()]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q[:, top] / np.sqrt(values[top]), values[top] / values.sum()


@pytest.mark.parametrize("d, rows", [(40, 300), (3, 50), (30, 4)])
def test_whitening_equals_dense_eigenvectors(spark, tmp_path, d, rows):
    rng = np.random.default_rng(d)
    base = (rng.standard_normal((rows, d)) * np.linspace(3, 1, d)).astype(np.float32)
    vectors = [*base.tolist(), *base[: rows // 3].tolist(), *[base[0].tolist()] * 50]
    bad = [None, [None] * d, [math.nan] * d, [math.inf] + [0.0] * (d - 1), [1.0] * (d + 1), []]
    table = [(k, v, 1.5) for k, v in enumerate(vectors)] + [(10_000 + k, v, None) for k, v in enumerate(bad)]
    spark.createDataFrame(table, "vec_id bigint, embedding array<float>, whitened double").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op13_whitening"](spark, str(tmp_path)).toPandas()
    n, deviation, white, share = dense(vectors)
    assert len(got) == len(vectors) * white.shape[1] and (got.n == n).all() and (got.identity_error < 1e-9).all()
    for c in range(white.shape[1]):
        own = got[got.component == c + 1].set_index("vec_id").loc[range(len(vectors))]
        assert (own.deviation.to_numpy() == deviation).all() and np.allclose(own.explained, share[c], rtol=1e-9)
        sign = np.sign(own.whitened.iloc[0] * white[0, c])
        assert np.allclose(own.whitened, sign * white[:, c], atol=1e-9)


def test_whitening_without_components(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id bigint, embedding array<float>")
    assert whitening.report(one).count() == 0 and whitening.report(one.limit(0)).count() == 0
    assert whitening.report(one.where("vec_id = 3")).count() == 0


def test_deviations_beyond_64_bits():
    x = np.array([[2**40, 1], [0, 0]])
    assert whitening.deviations(x, 2, [2**40, 1]) == [None, None]
    assert whitening.deviations(np.array([[2**30, 0]]), 1, [0, 0]) == [2**60]
