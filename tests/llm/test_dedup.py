from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, exact_dedup, line_dedup


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_exact_matches_brute_force_on_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(exact_dedup.mark(odd_docs)) == brute_exact(rows)


def test_exact_matches_brute_force_on_many_copies(docs_of):
    rng = random.Random(3)
    rows = [(i, f"text {rng.choice([1, 1, 1, rng.randrange(400)])}  \t{'x' * rng.randrange(2)}") for i in range(-300, 700)]
    assert rows_of(exact_dedup.mark(docs_of(rows))) == brute_exact(rows)


def test_exact_keeps_one_row_of_repeated_rows_and_all_columns(odd_docs):
    got = exact_dedup.distinct_documents(odd_docs)
    assert got.columns == odd_docs.columns
    assert rows_of(got.select("doc_id")) == rows_of(odd_docs.where("doc_id IN (1, 3, 4, 5, 6, 7, 8, 10) OR doc_id IS NULL").select("doc_id"))


@pytest.mark.parametrize("ids", [[0] + [10**17 + k for k in range(299)], [None] * 300, [7] * 300, [None] * 299 + [-1]])
def test_exact_buckets_are_bounded_for_any_ids(docs_of, monkeypatch, ids):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 10)
    seen, lookup = [], exact_dedup.lookup

    def spy(batch, index, buckets):
        seen.append((batch.count(), index.agg(F.sum("n")).first()[0] or 0, buckets))
        return lookup(batch, index, buckets)

    monkeypatch.setattr(exact_dedup, "lookup", spy)
    rows = [(i, f"text {k % 200}") for k, i in enumerate(ids)]
    assert rows_of(exact_dedup.mark(docs_of(rows))) == brute_exact(rows)
    (batch, history, buckets), = seen
    assert max(batch, history) <= 10 * buckets
    if len(set(ids)) == len(ids):
        assert history > 100


def test_exact_empty_table(docs_of):
    assert exact_dedup.mark(docs_of([])).count() == 0
    assert exact_dedup.distinct_documents(docs_of([])).count() == 0


def test_perfect_hash_is_minimal_and_checks_bytes(spark):
    words = np.random.default_rng(1).integers(0, 2**64, (5_000, 4), np.uint64)
    mph = exact_dedup.PerfectHash.build(words)
    assert sorted(mph.slots(words)) == list(range(5_000))
    keys = [(bytes(w.tobytes()), 5) for w in words[:100]]
    history = spark.createDataFrame([(k, i, 1) for k, i in keys], "digest binary, winner bigint, size bigint")
    index = exact_dedup.build_index(history, 3)
    new = [(bytes(words[5].tobytes()), 900, 2), (bytes(words[4_000].tobytes()), 901, 1)]
    batch = spark.createDataFrame(new, "digest binary, winner bigint, size bigint")
    got = {r.keep_id: (r.group_size, r.member) for r in exact_dedup.lookup(batch, index, 3, emit_history=False).collect()}
    assert got == {5: (3, True), 901: (1, False)}


# --- near duplicates

def brute_classes(rows):
    s = bagminhash.Shingler()
    h = [s.hashes((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, all_ = bagminhash.overlap(h[a], h[b]) if len(h[a]) and len(h[b]) else (0, 1)
            if (rows[a][1] or "") == (rows[b][1] or "") or both >= 0.8 * all_ - 1e-9:
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    out = []
    for g in groups.values():
        known = [x for x in g if x is not None]
        out += [(i, min(known) if known else None, len(g)) for i in g]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def near_copies(rng, n, words=60):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        text[rng.randrange(words)] = f"new{rng.randrange(9)}"
        yield " ".join(text)


def test_near_classes_match_brute_force(docs_of):
    rng = random.Random(5)
    texts = [t for n in (40, 7, 2, 2, 1, 1) for t in near_copies(rng, n)]
    texts += ["a b", "a b", "a  b", "", None, "!!!", "???", "one two three four five six", "rep " * 50, "rep " * 45, "rep " * 20]
    # a chain: neighbours are similar, the ends are not
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 60, 8)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = bagminhash.classes(docs_of(rows)).select("doc_id", "class_id", "class_size")
    assert rows_of(got) == brute_classes(rows)


def test_near_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(bagminhash.classes(odd_docs).select("doc_id", "class_id", "class_size")) == brute_classes(rows)
    kept = bagminhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 7, 8, 10, None} and kept.count() == 8


def test_near_repeated_rows_are_compared_once(docs_of, monkeypatch):
    sizes, stage = {}, bagminhash.stage

    def counted(df, name):
        out = stage(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(bagminhash, "stage", counted)
    base = [f"w{k}" for k in range(80)]
    rows = [(1, " ".join(base))] * 300 + [(2, " ".join([*base[:-1], "other"]))] * 300 + [(None, " ".join([*base, "more"]))] * 50
    got = bagminhash.classes(docs_of(rows)).select("doc_id", "class_id", "class_size").distinct().collect()
    assert sorted(got, key=str) == sorted([(1, 1, 650), (2, 1, 650), (None, 1, 650)], key=str)
    assert sizes["texts"] == [3] and max(n for name, own in sizes.items() if name != "signatures" for n in own) <= 36 * 3


def test_near_empty_table(docs_of):
    assert bagminhash.classes(docs_of([])).count() == 0


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.9):
        a = {int(x): int(c) for x, c in zip(rng.integers(0, 2**63, 400), rng.integers(1, 9, 400))}
        b = {x: max(1, int(c * share)) for x, c in a.items()}
        x = np.repeat(np.array(list(a), np.uint64), list(a.values()))
        y = np.repeat(np.array(list(b), np.uint64), list(b.values()))
        both, all_ = bagminhash.overlap(x, y)
        agree = np.mean([(bagminhash.signature(x ^ np.uint64(s)) == bagminhash.signature(y ^ np.uint64(s))).mean() for s in range(30)])
        assert abs(agree - both / all_) < 0.04


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in bagminhash.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}


# --- lines

def brute_lines(rows):
    first, seen, occurrences = {}, [], []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = frozenset(x for x in re.split("[ \t\r\f\x0b]", line.lower()) if x)
            if w:
                if w not in first:
                    first[w] = len(occurrences)
                    seen.append(w)
                occurrences.append((i, t, k, w))
    links, later = {w: 0 for w in seen}, set()
    for a in range(len(seen)):
        for b in range(a):
            if len(seen[a] & seen[b]) >= 0.8 * len(seen[a] | seen[b]) - 1e-9:
                links[seen[a]] += 1
                links[seen[b]] += 1
                later.add(seen[a])
    out = {}
    for n, (i, t, k, w) in enumerate(occurrences):
        gone, total = out.setdefault((i, t), ([], [0]))
        total[0] += links[w]
        if w in later or first[w] != n:
            gone.append(k)
    return {key: (gone, total[0]) for key, (gone, total) in out.items()}


def test_lines_match_brute_force(docs_of):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))] for _ in range(40)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line) + rng.choice(["", " ", "\t"]))
        texts.append("\n".join(lines))
    rows = list(enumerate([*texts, None, "", "\n\n", "the same line again and again"] + ["the same line again and again"] * 5))
    want = brute_lines(rows)
    for r in line_dedup.report(docs_of(rows)).collect():
        text = rows[r.doc_id][1]
        gone, total = want.get((r.doc_id, text), ([], 0))
        assert (r.n_lines, r.n_removed, r.n_links) == (0 if text is None else len(text.split("\n")), len(gone), total)
        assert r.removed_sha256 == hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest()
    for r in line_dedup.without_repeats(docs_of(rows)).collect():
        text = rows[r.doc_id][1]
        gone = set(want.get((r.doc_id, text), ([], 0))[0])
        assert r.text == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))


def report_of(rows):
    want = brute_lines(rows)
    out = []
    for i, t in rows:
        gone, total = want.get((i, t), ([], 0))
        out.append((i, 0 if t is None else len(t.split("\n")), len(gone), total, hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def sized_lines(rng, n):
    """Lines of all sizes over few words, and copies with some words more, less or other."""
    vocabulary = [f"v{k}" for k in range(150)]
    out = []
    for _ in range(n):
        line = rng.sample(vocabulary, rng.randrange(1, 60))
        out.append(line)
        for _ in range(rng.randrange(3)):
            other = [w for w in line if rng.random() > 0.08]
            out.append(other + rng.sample(vocabulary, rng.randrange(0, 1 + len(line) // 6)))
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("hot", [0, 15, 127])
def test_lines_joined_by_range_of_sizes_match_brute_force(docs_of, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    lines = sized_lines(random.Random(hot), 120)
    rows = [(k if k != 9 else None, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(len(lines) // 3)]
    assert rows_of(line_dedup.report(docs_of(rows))) == report_of(rows)


def test_lists_of_a_common_word_are_split_by_size(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 20)
    rows = [(k, " ".join(["common", *[f"w{j}" for j in range(k)]])) for k in range(20, 220)]  # the later words are rarer
    texts = [(i, " ".join(t.split()[:1] + [f"{i}x{j}" for j in range(len(t.split()) - 1)])) for i, t in rows]  # all words but one occur once
    docs = docs_of(texts + [(1000 + i, t + " more") for i, t in texts])
    got = line_dedup.postings(line_dedup.classes(line_dedup.keyed(line_dedup.lines(docs), line_dedup.rarity(docs))))
    assert got.groupBy("key").count().agg(F.max("count")).first()[0] < 100  # of 400 lines with the common word
    assert rows_of(line_dedup.report(docs_of(rows))) == report_of(rows)


def test_lines_of_a_group_travel_once(docs_of, monkeypatch):
    kept, stage = {}, line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: kept.setdefault(name, stage(df, name)))
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([*words, f"own{k}"])) for k in range(80)]
    assert rows_of(line_dedup.report(docs_of(rows))) == report_of(rows)
    assert kept["links"].count() == 80 * 79 // 2
    assert kept["sets"].count() == 80 and kept["sets"].agg(F.sum(F.size("meet"))).first()[0] == 79  # not two sets a pair


def test_lines_of_a_repeated_id_are_read_by_text(docs_of, monkeypatch):
    kept, stage = {}, line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: kept.setdefault(name, stage(df, name)))
    rng = random.Random(4)
    rows = sorted({(i, t) for i in (None, 3) for t in sized_lines(rng, 40)}, key=str)
    got = line_dedup.report(docs_of(rows))
    assert sorted((r.doc_id or 0, r.n_links) for r in got.collect()) == sorted((i or 0, links) for i, _, _, links, _ in report_of(rows))
    assert got.agg(F.sum("n_removed")).first()[0] < len(rows) // 2  # lines at one place of a repeated id: neither is the later
    assert kept["sets"].count() == kept["wanted"].count() > 20


def test_lines_odd_rows(odd_docs, docs_of):
    got = line_dedup.report(odd_docs)
    assert got.count() == odd_docs.count()
    gone = {(r.doc_id, r.n_removed) for r in got.collect()}
    assert {(8, 0), (9, 1), (6, 1), (1, 0), (None, 0)} <= gone
    assert line_dedup.without_repeats(odd_docs).columns == odd_docs.columns
    assert line_dedup.report(docs_of([])).count() == 0


def test_lines_plan_has_no_python(docs_of):
    df = line_dedup.report(docs_of(["a b c d e", "a b c d e f"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 51])
def test_prefix_reaches_far_enough(n):
    assert n - int(np.ceil(n * 0.8 - 1e-9)) + 1 >= 1
    assert F is not None


def test_second_hash_of_words_is_not_chained_to_the_first(spark):
    w = F.sort_array("w")
    r = spark.createDataFrame([(["b", "a"],)], "w array<string>").select(*line_dedup.same_words(F.col("w")), F.xxhash64(w, F.lit(1)).alias("chained")).first()
    assert len({r.h0, r.h1, r.chained}) == 3
