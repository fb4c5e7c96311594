from __future__ import annotations

import hashlib
import itertools
import pickle
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, hilbert, langid, toxicity
from tidemark.llm.queries import public_ranks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_passages(rows, items):
    windows = []
    for item, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        windows += [(w[k : k + n], item) for k in range(len(w) - n + 1) if n]
    out = []
    for i, t in rows:
        w, hit, named = WORD.findall(lower(t)), set(), set()
        for g, item in windows:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    named.add(str(item))
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(3, "One two Three four five six seven eight nine ten eleven"), (12, "short item"), (5, "été über alles 1 2"), (6, None), (7, "..."), (12, "short item")]


def test_passages_match_brute_force(spark, docs_of, odd_docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rng = random.Random(1)
    texts = ["x one, two three FOUR five six seven eight nine ten y", "two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine",
             "a SHORT-item b short item", "Été über ALLES 1 2", None, "", "one two three four five six seven eight nine ten eleven " * 3]
    texts += [" ".join(rng.choice("short item one two three four five six".split()) for _ in range(30)) for _ in range(30)]
    docs = docs_of(list(enumerate(texts)))
    want = brute_passages(list(enumerate(texts)), ITEMS)
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect()), key=str) == want
    blocks = decontaminate.find_passages(docs, bench, block_bytes=20).select("row.doc_id", (F.size("spans") > 0).alias("hit"))
    assert {r.doc_id: r.hit for r in blocks.collect()} == {w[0]: w[5] for w in want}
    assert decontaminate.report(odd_docs, bench).count() == odd_docs.count()


def test_documents_or_spans_are_removed(spark, docs_of, odd_docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = docs_of([(1, "keep this short, item!  and that"), (2, "clean text"), (3, None)])
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3}
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "span").collect()}
    assert got == {1: "keep this !  and that", 2: "clean text", 3: None}
    same = decontaminate.decontaminate(odd_docs, bench.limit(0))
    assert same.columns == odd_docs.columns and same.count() == odd_docs.count()
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, "other")


# --- byte-level BPE

def test_ids_are_those_of_tiktoken_and_decode(docs_of, odd_docs, monkeypatch):
    ranks = public_ranks()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", None, "Hello, world's  end\n\n x", "a" * 700, "漢字かな交じり文" * 40, "🙂🙃 <|endoftext|>", "   tab\tx ", "don't DON'T 123456 ½"]
    texts += ["".join(rng.choice("abé \n'st漢.1") for _ in range(200)) for _ in range(20)]
    monkeypatch.setattr(bpe, "DICTIONARY", 40)  # most words are folded beside their document
    docs = docs_of(list(enumerate(texts)))
    for r in bpe.report(docs, ranks).collect():
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    got = bpe.encode(odd_docs, "text", ranks)
    assert got.select("row.*").columns == odd_docs.columns and got.count() == odd_docs.count()
    assert bpe.report(docs_of([]), ranks).count() == 0


def test_dictionary_is_small_in_a_worker():
    ranks, n = bpe.Ranks.__new__(bpe.Ranks), 100_000
    ranks.pattern, ranks.ranks = public_tokenizers.PATTERN, {bytes([k]): k for k in range(256)}
    words = [f" word{k}é" for k in range(n)]
    packed = pickle.dumps(bpe.Assembler(ranks, pa.array([bpe.latin(w.encode()) for w in words]), pa.array([np.array([k, k + 1], "<u4").tobytes() for k in range(n)], pa.binary())))
    tracemalloc.start()
    try:
        found = pickle.loads(packed).places([[words[7], "new", words[n - 1], "new", "x" * 70], [], ["other", words[7]]])
        assert tracemalloc.get_traced_memory()[1] < 80 * n  # Python objects for words and ids take about three times that
    finally:
        tracemalloc.stop()
    own = bpe._PLACE
    assert [np.frombuffer(x, "<u4").tolist() for x in found[0]] == [[7, 8, own, n - 1, n, own, *[120] * 70], [], [own, 7, 8]]
    assert found[1] == [["new"], [], ["other"]]
    pieces = bpe.Pieces(ranks)
    ids = pieces.filled([np.array(x, "<u4").tobytes() for x in ([97, own + 1, 98, own, own + 1], [], [own])], [[[99], [100, 101]], [], [[102, 103, 104]]])
    assert [x.tolist() for x in ids] == [[97, 100, 101, 98, 99, 100, 101], [], [102, 103, 104]] and pieces.decode(ids) == [b"adebcde", b"", b"fgh"]


def test_long_words_merge_like_folded_ones(spark):
    ranks = public_ranks()
    words = ["th", "a", "ouwhreble", "xyzzyxyzzyaaa", "éèéèéè", "<<<>>>"]
    df = spark.createDataFrame([(bpe.latin(w.encode()),) for w in words], "w string")
    for w, r in zip(words, df.select(bpe.encoded(F.col("w"), ranks.literals()).alias("x")).collect()):
        assert r.x == bpe.merge_long(w.encode(), ranks.ranks)


# --- classifiers

def test_language_id_on_held_out_texts(spark, docs_of, odd_docs):
    rng = random.Random(6)
    stems = {"en": "the of and thing with over".split(), "de": "der und ung schaft über groß".split(), "fr": "le être çois aux que où".split()}
    rows = [(k, lang, " ".join("".join(rng.choices(s, k=2)) for _ in range(12))) for k in range(120) for lang, s in stems.items()]
    train = spark.createDataFrame([(k, t, lang) for k, lang, t in rows if k % 4 != 2] + [(None, None, "en"), (5, "der der", None)], "id bigint, text string, lang string")
    model = langid.fit(train)
    test = spark.createDataFrame([(lang, t) for k, lang, t in rows if k % 4 == 2], "want string, text string")
    got = langid.identify(test, model, F.col("text")).select("row.want", "lang_pred", "score").collect()
    assert sum(r.want == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: (r.lang_pred, r.s) for r in langid.identify(odd_docs, model, F.col("text")).select("row.doc_id", "lang_pred", F.col("score").alias("s")).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0)
    none = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.identify(test, none, F.col("text")).collect()} == {"und"}


def test_bloom_masks_contain_what_was_added_for_many_languages():
    model = langid.BitSlicedFilter([f"l{k:03}" for k in range(130)])
    h = [langid.grams(f"wort{k} anders{k}") for k in range(130)]
    for k in range(130):
        model.add(k, h[k])
    model.close()
    assert all(model.counts(h[k])[k] == len(h[k]) for k in range(130))


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(400):
        v = rng.random(5)
        vectors.append(dict(zip(map(int, rng.choice(30, 5, replace=False)), v / np.linalg.norm(v))))
    index = toxicity.NeighbourIndex(vectors, [k % 2 for k in range(400)], list(range(400)), 30)
    for q in vectors[:40]:
        want = sorted((round(sum(q[f] * v.get(f, 0.0) for f in q), 9) for v in vectors), reverse=True)[:10]
        got = [round(s, 9) for s, _ in index.nearest(q, 10)]
        assert got == [w for w in want if w > 0]


def test_toxicity_is_learned_and_defined_for_odd_texts(spark, docs_of, odd_docs):
    rng = random.Random(8)
    bad = ["vile", "awful"]
    rows, labels = [], []
    for k in range(600):
        y = int(k % 5 == 0)
        w = [f"n{rng.randrange(300)}" for _ in range(40)] + (rng.choices(bad, k=2) if y else [])
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, y))
    docs, known = docs_of(rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, toxicity.learnable(known))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, F.col("text")).select("row.doc_id", "score").collect()}
    assert all((got[k] >= 0.7) == bool(y) for k, y in labels)
    odd = toxicity.score(odd_docs, model, F.col("text"))
    assert odd.count() == odd_docs.count() and odd.where("score < 0 OR score > 0.5").count() == 0
    none = toxicity.fit(docs, known.limit(0))
    assert {r.score for r in toxicity.score(docs, none, F.col("text")).collect()} == {0.0}


def test_only_verified_copies_of_one_label_are_dropped(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [(k, k % 2, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(200)]  # a shared passage
    long = [f"c{k}" for k in range(100)]
    texts += [(300, 0, " ".join(long)), (301, 0, " ".join(long[:-1] + ["other"])), (302, 1, " ".join(long))]  # a copy, and one of the other label
    texts += [(400, 0, " ".join(long[:60] + [f"d{k}" for k in range(40)]))]
    picked = spark.createDataFrame(texts, "id bigint, y int, text string")
    found = toxicity._terms(picked).select(F.col("row.id").alias("at"), "row.id", "row.y", "terms", "keys", "grams").persist()
    got = {r.id for r in toxicity._without_copies(found).collect()}
    assert got == {i for i, _, _ in texts} - {301}


# --- shards

def test_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        names = [f"a{k}" for k in range(n)]
        cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), ", ".join(f"{x} int" for x in names))
        rows = cells.withColumn("h", hilbert.hilbert_index([F.col(x) for x in names], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << n * bits))
        assert all(sum(abs(a[x] - b[x]) for x in names) == 1 for a, b in zip(rows, rows[1:]))


def check_shards(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sum(map(len, by.values())) == n and all(0 <= s < hilbert.SHARDS for s in by)
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    sizes = [len(by.get(s, [])) for s in range(hilbert.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    return by


def test_shards_are_even_runs_of_the_curve(spark, docs_of, odd_docs, tmp_path):
    rng = random.Random(2)
    docs = docs_of([(k if k % 50 else 7, "x" * int(rng.paretovariate(0.7))) for k in range(1000)])
    got = hilbert.document_shards(docs)
    by = check_shards(got.collect(), 1000)
    assert all(max(r.curve for r in by[s]) <= min(r.curve for r in by[s + 1]) for s in range(hilbert.SHARDS - 1))
    check_shards(hilbert.document_shards(odd_docs).collect(), odd_docs.count())
    assert hilbert.document_shards(docs_of([])).count() == 0
    runs = hilbert.manifest(got, ["size", "doc_id"])
    assert runs.agg(F.sum("rows")).first()[0] == 1000
    some = hilbert.prune(runs, {"size": (5000, 10**9)})
    assert some.count() < runs.count()
    held = {r.shard for r in got.where("size >= 5000").collect()}
    assert held <= {r.shard for r in some.collect()}
    hilbert.write_shards(got, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 1000
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
