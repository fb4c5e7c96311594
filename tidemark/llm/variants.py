"""Spelling variants: words at one edit from each other, found by a relational frontier over a trie.

Words are counted over all texts (counters in the tasks, one shuffle). Every word then walks down two tries, one of the
words and one of the reversed words. A *state* is (word, position, node, edits): so many characters of the word lead to
the node, with 0 edits or 1. Level by level, the states are joined with the edges that leave their nodes:

* an *edge* is the common prefix of all words that share a node and their next character (the least and the greatest of
  them show it), so a stretch without a branch is one edge and a long word does not cost a level per character. Edges of
  a level are grouped from the states of that level with 0 edits, which are the words themselves, and are read once;
* a state follows the edge of its next character if the rest of the word begins with the edge's text;
* a state with 0 edits also takes the node's other edges, with one character replaced or inserted there;
* a state with 1 edit that has used up its word at the end of another word is a pair of near words. Deletions are
  insertions seen from the other word.

An edit lies in the later half of a word or in the later half of the reversed word, so states branch only from the
middle on, where nodes have few edges: the walk is close to linear in the vocabulary. The join is on the node, which has
at most one edge per letter of the rule, so it multiplies no group by itself. Each level is one job, whose states and
pairs are written to the shared folder. The number of levels is that of branching prefixes on the deepest path, which grows with the logarithm of a
natural vocabulary.

Defined results: a null text has no words; a null id counts as empty before the colon; repeated rows count again;
an empty table gives no words; words with equal counts are taken in code-point order. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, stage, stage_path, utf8

#: Letters of a word (after A-Z became a-z); shortest word and least count.
LETTERS = re.compile("[a-zÀ-ÿ]+")
SHORTEST, LEAST = 5, 3
#: One run in so many loses a character, by the checksum of document and run.
DAMAGE = 97
#: A form has at least so many times its variant's count, so chains of forms are at most 63 long.
RATIO = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it passes the counts on; bytes of text that it takes at a time.
_COUNTERS, _BATCH = 300_000, 1_000_000
#: Characters of the first edges: no edit lies before the middle of a word, which is here or later.
_ROOT = SHORTEST // 2


def damaged(run: str, key: int) -> str:
    """The run, or the run without one character if the checksum says so; ``key`` is the checksum of what precedes it."""
    h = zlib.crc32(run.encode(), key)
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words that occur often enough."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for k in range(0, len(words), 50_000):
                some = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[w] for w in some], pa.int64())], names=["word", "n"])
            seen.clear()

        for b in batches:
            for part in bounded(b, ["text"], _BATCH):
                for key, raw in zip(part.column("key").to_pylist(), utf8(part.column("text"))):
                    if not raw:
                        continue
                    crc = zlib.crc32(f"{key or ''}:".encode())
                    for run, n in Counter(LETTERS.findall(raw.translate(_LOWER).decode())).items():
                        if len(run) >= SHORTEST:
                            seen[damaged(run, crc)] += n
                if len(seen) > _COUNTERS:
                    yield from out()
        yield from out()

    counts = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(fn, "word string, n bigint")
    return counts.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _part(text: Column, start: Column, length: Column) -> Column:
    """``length`` characters of the text after the first ``start``."""
    return text.substr(start + 1, length)


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts."""
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(a == b, F.length(a)).otherwise(F.when(differs == 0, F.length(a)).otherwise(differs - 1)).cast("int")


def _edges(states: DataFrame) -> DataFrame:
    """The edges that leave the nodes of the words' own states."""
    own = states.where((F.col("edits") == 0) & (F.col("first") != ""))
    least, most = F.col("least"), F.col("most")
    groups = own.groupBy("way", "node", "first").agg(
        F.min("word").alias("least"), F.max("word").alias("most"), F.count(F.lit(1)).alias("words"),
        F.min("size").alias("shortest"), F.max("size").alias("longest"))
    child = groups.withColumn("depth", _common(least, most))
    return child.select("way", "node", "first", F.substring(least, F.lit(1), F.col("depth")).alias("child"), "depth",
                        (F.length(least) == F.col("depth")).alias("ends"), (F.col("words") > 1).alias("more"), "shortest", "longest")


def _moves(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one edge each, without those that can come to nothing; ``kind`` parts pairs from states to go on."""
    word, size, at, depth = F.col("word"), F.col("size"), F.col("position"), F.col("depth")
    turned = edges.withColumnRenamed("first", "turn")
    met = states.join(turned, ["way", "node"])
    taken = depth - F.length("node")
    label = lambda skip: _part(F.col("child"), F.length("node") + skip, taken - skip)
    exact, own = F.col("edits") == 0, F.col("turn") == F.col("first")
    can = lambda longer: (F.col("shortest") <= size + longer) & (F.col("longest") >= size + longer)
    edit = exact & ~own & (at >= F.col("half"))
    along = F.when(own & (exact | (_part(word, at, taken) == label(0))), F.struct((at + taken).alias("position"), F.col("edits")))
    replaced = F.when(edit & (F.col("first") != "") & can(0) & (_part(word, at + 1, taken - 1) == label(1)), F.struct((at + taken).alias("position"), F.lit(1).alias("edits")))
    inserted = F.when(edit & can(1) & (_part(word, at, taken - 1) == label(1)), F.struct((at + taken - 1).alias("position"), F.lit(1).alias("edits")))
    moved = met.where(own | edit).select("way", "word", "size", "half", F.col("child").alias("node"), "ends", "more",
                                         F.explode(F.array_compact(F.array(along, replaced, inserted))).alias("to"))
    whole, edited = F.col("to.position") == size, F.col("to.edits") == 1
    kind = F.when(edited & whole, F.when(F.col("ends"), "pair")).when(F.col("more"), "state")
    return moved.select("way", "word", "size", "half", "node", "to.position", "to.edits", kind.alias("kind")).where(F.col("kind").isNotNull())


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs ``word``, ``near`` of words of ``words`` that differ by one inserted, deleted or replaced character."""
    spark, size = words.sparkSession, F.length("word")
    start = lambda way, half: words.select(F.lit(way).alias("way"), (F.reverse("word") if way else F.col("word")).alias("word"), size.alias("size"), half.cast("int").alias("half"))
    states = start(0, F.floor(size / 2)).unionByName(start(1, size - F.floor(size / 2)))
    # The first edges all have _ROOT characters: the root's children are the groups of words that begin alike.
    states = states.withColumns({"node": F.substring("word", 1, _ROOT), "position": F.lit(_ROOT), "edits": F.lit(0)})
    schema, pairs = states.schema.add("kind", "string"), []
    while True:
        states = states.withColumn("first", _part(F.col("word"), F.col("position"), F.lit(1)))
        path = stage_path(spark, "states")
        _moves(states, _edges(states)).write.option("compression", "zstd").partitionBy("kind").parquet(path)
        moved = spark.read.schema(schema).parquet(path)
        pairs.append(moved.where("kind = 'pair'").select("way", "word", F.col("node").alias("near")))
        states = moved.where("kind = 'state'").drop("kind")
        if states.isEmpty():
            break
    found = reduce(DataFrame.unionByName, pairs)
    forward = lambda c: F.when(F.col("way") == 1, F.reverse(c)).otherwise(F.col(c))
    found = found.select(forward("word").alias("word"), forward("near").alias("near"))
    back = found.where(F.length("near") > F.length("word")).select(F.col("near").alias("word"), F.col("word").alias("near"))
    return found.unionByName(back).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of every word with a form: pointers are doubled until chains of 63 are followed to the end."""
    at = forms.select("word", F.col("form").alias("root"))
    for k in range(6):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = stage(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{k}")
        at = joined.drop("moved")
        if joined.where("moved").isEmpty():
            break
    return at


def variants(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``form``, ``root``, ``n_near``, ``form_n`` of every row of ``words`` (distinct words and counts)."""
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("best"))
    known = words.join(best, "word", "left")
    is_form = -F.col("best.n") >= RATIO * F.col("n")
    known = stage(known.select("word", "n", F.when(is_form, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per word."""
    return variants(stage(count_words(docs), "words"))
