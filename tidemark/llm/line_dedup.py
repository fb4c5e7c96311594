"""Near-duplicate lines by an exact set-similarity join. DataFrame functions only.

A line is the set of its lower-cased words between blanks; lines are duplicates at a Jaccard similarity of
``THRESHOLD`` or more. A line is removed if an earlier one, in order of document id and place, is a duplicate.

Lines with the same set of words are one class, joined once. Words are ordered by rarity (occurrences,
counted over all lines in ``RARITY`` hash buckets, a constant of fixed size; any common order is exact). Two
classes can only be similar if they share a word among the rarest few of each (prefix filter, shorter for the
smaller set), at places that leave enough words behind it (positional filter), with sizes in proportion (length
filter) and few different bits in a 128-bit map of the parity of their words. Words that occur more than
``2 ** (HOT / 5)`` times are joined by range of sizes as well, so that their lists stay short.

What is left is verified word by word: classes that belong together meet at the least class any of them is
a candidate of, each with its line read again from the documents, and are compared there. So a group's lines
travel once and not with every pair.

Classes, not lines, are joined, so a line repeated in a third of all documents is one row of the join. Tables
between steps are written to the shared folder.

Defined results: null texts have no line; lines without words are kept; lines of one to three words only
match lines of the same words; words are told apart by 64-bit hashes, sets of words by a 128-bit hash; repeated rows (same id and
text) count as one document, and each gets its result; rows with a null id come last; of lines at the same place
of two texts with one id, neither is the earlier one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import digest128, stage

#: Sets of n and m words reach it if they share 4 / 9 of n + m or more; the numbers 4, 5 and 9 below follow from that.
THRESHOLD = 0.8
#: Buckets of the word counts; bits of a word's hash in its key; bits of the filter of lines that are read again.
RARITY, HASH_BITS, WANTED = 1 << 21, 56, 7 << 21
#: Level of words that are joined by range of sizes, and the ratio of a range.
HOT, RANGE = 35, 1.15


def _kept(df: DataFrame, name: str) -> DataFrame:
    """As ``stage``; the shuffles behind it, which nothing reads again, go when the driver collects its garbage: at once, not when its memory is full."""
    got = stage(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return got


def _split(text: Column) -> Column:
    for blank in "\t\r\f\x0b":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, " ")


def words(line: Column) -> Column:
    """Distinct lower-cased words of a line, as 64-bit hashes."""
    return F.array_distinct(F.array_remove(F.transform(_split(F.lower(line)), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def lines(docs: DataFrame) -> DataFrame:
    """``doc``, ``version`` (of the text), ``line`` (from 0) and sorted ``words`` of every line with words."""
    text = docs.select(F.col("doc_id").alias("doc"), digest128(F.col("text")).alias("version"), F.split("text", "\n").alias("bodies"))  # a digest a document
    text = text.select("doc", "version", F.posexplode("bodies").alias("line", "body"))
    return text.where(F.col("body").rlike("[^ \t\r\f\x0b]")).select("doc", "version", "line", F.sort_array(words(F.col("body"))).alias("words"))


def same_words(w: Column) -> list[Column]:
    """128-bit hash of a sorted set of words, as two columns; a literal ahead of the words is another seed for all of them."""
    return [F.xxhash64(w).alias("h0"), F.xxhash64(F.lit(1), w).alias("h1")]


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(RARITY - 1).cast("int")  # never null, unlike pmod: arrays of keys are sorted as plain numbers


def rarity(docs: DataFrame) -> Column:
    """How often words of each bucket occur: a constant of one byte per bucket, 1 for single words, in fifths of an octave."""
    every = docs.select(F.explode(_split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")))).alias("w"))
    counted = every.groupBy(_bucket(F.xxhash64("w")).alias("b")).count()
    level = F.least(F.floor(F.log2("count") * 5) + 1, F.lit(127)).cast("int")
    levels = np.zeros(RARITY, np.uint8)
    for batch in counted.select("b", level.alias("level")).toArrow().to_batches():  # RARITY rows at most
        levels[batch.column("b").to_numpy()] = batch.column("level").to_numpy()
    return F.lit(levels.tobytes())


def _byte(constant: Column, at: Column) -> Column:
    """A byte below 128 of a constant."""
    return F.ascii(F.substring(constant, at + 1, F.lit(1)).cast("string"))


def _parity(hashes: str, low: bool) -> Column:
    """Half of the 128-bit map: a bit is set if an odd number of words falls on it. Different words change one bit each at most."""
    def flip(a: Column, h: Column) -> Column:
        own = h.bitwiseAND(1) if low else F.bitwise_not(h).bitwiseAND(1)
        return a.bitwiseXOR(F.call_function("shiftleft", own, F.shiftright(h, 58).cast("int")))
    return F.aggregate(hashes, F.lit(0).cast("long"), flip)


def keyed(all_lines: DataFrame, counts: Column) -> DataFrame:
    """Lines with ``h0``, ``h1`` (hash of the word set), ``n``, ``p0``, ``p1`` (parity map) and ``prefix``.

    ``prefix`` has the rarest words as hashes of 30 bits with a last bit for words above ``HOT``; 0 for words met once,
    which have no partner. Words with the same hash are candidates more often, nothing else.
    """
    def key(h: Column) -> Column:
        return F.shiftleft(_byte(counts, _bucket(h)).cast("bigint"), HASH_BITS).bitwiseOR(h.bitwiseAND((1 << HASH_BITS) - 1))

    def short(k: Column) -> Column:
        level = F.shiftright(k, HASH_BITS)
        return F.when(level > 1, F.shiftleft(k.bitwiseAND((1 << 30) - 1), 1).bitwiseOR((level > HOT).cast("bigint"))).otherwise(F.lit(0)).cast("int")

    most = F.expr("size(words) div 5 + 1").cast("int")  # n - ceil(n * THRESHOLD) + 1
    prefix = F.transform(F.slice(F.sort_array(F.transform("words", key)), F.lit(1), most), short)
    return all_lines.select("doc", "version", "line", *same_words(F.col("words")), F.size("words").alias("n"), _parity("words", True).alias("p0"), _parity("words", False).alias("p1"),
                            F.when(F.size("words") > 3, prefix).alias("prefix"))


def classes(line_keys: DataFrame) -> DataFrame:
    """One row per set of words with its first line (``first``: ``doc``, ``line``; ``version`` of the text) and the number of its lines (``size``)."""
    least = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "line", "version")).alias("least")
    same = [F.first(c).alias(c) for c in ("n", "p0", "p1", "prefix")]
    grouped = line_keys.groupBy("h0", "h1").agg(least, F.count(F.lit(1)).alias("size"), *same)
    return grouped.select(F.monotonically_increasing_id().alias("id"), "h0", "h1", F.struct("least.last", "least.doc", "least.line").alias("first"), "least.version", "size", "n", "p0", "p1", "prefix")


def _range(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(RANGE))).cast("int")


def postings(cls: DataFrame) -> DataFrame:
    """A row per class and word of its prefix, for words above ``HOT`` and the range of sizes; similar sets share a ``key``.

    Similar sets of n and m words differ in (n + m) / 9 words at most. The first word they share in the order of rarity,
    at place p of n words, leaves the n - p words that similar sets must share: 5 n - 9 p >= 4 m, for both of them. The larger
    set is in its own range alone, the smaller one in all ranges of larger sets that leaves.
    """
    before = F.transform("prefix", lambda w, k: F.struct(w.alias("word"), F.coalesce(F.get("prefix", k - 1), F.lit(0)).alias("before")))
    each = cls.where(F.col("prefix").isNotNull()).select("id", "n", "p0", "p1", F.posexplode(before).alias("at", "w")).where("w.word != 0")
    left = F.col("n") * 5 - F.col("at") * 9
    most = F.least(F.expr("n * 5 div 4"), F.expr("(5 * n - 9 * at) div 4")).cast("int")  # words of a larger set that fits
    own = _range(F.col("n"))
    ranges = (F.when(F.col("w.word").bitwiseAND(1) == 0, F.array(F.lit(-1)))
              .when(most > F.col("n"), F.sequence(own, _range(most))).otherwise(F.array(own)))
    posts = each.select("id", "n", left.alias("left"), "p0", "p1", "w", F.explode(ranges).alias("range"))
    return posts.select("id", "n", "left", "p0", "p1", F.hash("w.word", "range").alias("key"), "w.before")


def candidates(cls: DataFrame) -> DataFrame:
    """Pairs of classes (``a`` < ``b``) that pass the filters. Pairs that also share the words right before (``before``) are met there."""
    posts = postings(cls)
    x, y = (posts.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "left", "p0", "p1", "before")]) for side in "ab")
    differ = F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0"))) + F.bit_count(F.col("a_p1").bitwiseXOR(F.col("b_p1")))
    fits = ((F.col("b_left") >= F.col("a_n") * 4) & (F.col("a_left") >= F.col("b_n") * 4) & (F.col("a_id") < F.col("b_id"))
            & ((F.col("a_before") != F.col("b_before")) | (F.col("a_before") == 0)) & (differ * 9 <= F.col("a_n") + F.col("b_n")))
    return x.hint("merge").join(y, "key").where(fits).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def _meetings(pairs: DataFrame) -> DataFrame:
    """``id``, ``home`` (the least class that it is a candidate of, or itself) and ``meet``, the homes of all lesser ends of its pairs."""
    least = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a")).groupBy("id").agg(F.min("other").alias("other"))
    least = least.select("id", F.least("id", "other").alias("home"))
    met = pairs.join(least.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), F.col("home").alias("meet")).distinct()
    return least.join(met.groupBy("id").agg(F.collect_list("meet").alias("meet")), "id", "left")


def _among(wanted: DataFrame, at: list[str]) -> Column:
    """Filter that passes the wanted lines, and few others while they are fewer than ``WANTED``: a constant of fixed size, 7 bits a byte."""
    bit = F.pmod(F.xxhash64(*at), F.lit(WANTED))
    byte, one = F.floor(bit / 7).cast("int"), F.call_function("shiftleft", F.lit(1), (bit % 7).cast("int"))
    full = wanted.groupBy(byte.alias("byte")).agg(F.bit_or(one).alias("ones")).toArrow()  # WANTED / 7 rows at most
    constant = np.zeros(WANTED // 7, np.uint8)
    constant[full.column("byte").to_numpy()] = full.column("ones").to_numpy()
    return _byte(F.lit(constant.tobytes()), byte).bitwiseAND(one) != 0


def links(docs: DataFrame, cls: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of classes whose sets are similar (``a`` < ``b``) and whether the first line of either is the later one."""
    wanted = _kept(cls.select("id", "first", "version").join(_meetings(pairs), "id"), "wanted")
    text = docs.select(F.col("doc_id").alias("d"), digest128(F.col("text")).alias("v"), F.split("text", "\n").alias("bodies")).select("d", "v", F.posexplode("bodies").alias("k", "body"))
    text = text.where(_among(wanted.select(F.col("first.doc").alias("d"), F.col("first.line").alias("k")), ["d", "k"]))
    place = F.col("d").eqNullSafe(F.col("first.doc")) & (F.col("v") == F.col("version")) & (F.col("k") == F.col("first.line"))
    found = text.join(wanted.hint("shuffle_hash"), place).dropDuplicates(["id"]).select("id", "first", "home", "meet", F.sort_array(words(F.col("body"))).alias("words"))
    found = found.select("*", F.size("words").alias("n"), _parity("words", True).alias("p0"), _parity("words", False).alias("p1"))
    sets = _kept(found, "sets")
    own = ("id", "n", "p0", "p1", "first", "words")
    x = sets.select(F.col("home").alias("meet"), *[F.col(c).alias(f"a_{c}") for c in own])  # the lesser end of a pair, at one place
    y = sets.select(F.explode("meet").alias("meet"), *[F.col(c).alias(f"b_{c}") for c in own])
    differ = F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0"))) + F.bit_count(F.col("a_p1").bitwiseXOR(F.col("b_p1")))
    total = F.col("a_n") + F.col("b_n")
    similar = (F.col("a_id") < F.col("b_id")) & (differ * 9 <= total) & (F.size(F.array_intersect("a_words", "b_words")) * 9 >= total * 4)
    return x.join(y, "meet").where(similar).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"),
                                                   (F.col("b_first") < F.col("a_first")).alias("a_later"), (F.col("a_first") < F.col("b_first")).alias("b_later"))


def decisions(docs: DataFrame) -> DataFrame:
    """``doc``, ``version``, ``line``, ``removed`` and ``links`` (of its class to others) of every line that is removed or linked."""
    line_keys = _kept(keyed(lines(docs), rarity(docs)), "lines")
    cls = _kept(classes(line_keys), "classes")
    pairs = _kept(candidates(cls), "pairs")
    linked = _kept(links(docs, cls, pairs), "links")
    ends = linked.select(F.col("a").alias("id"), F.col("a_later").alias("later")).union(linked.select("b", "b_later"))
    marks = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"), F.max("later").alias("later"))
    marked = cls.select("id", "h0", "h1", "first", "size").join(marks, "id", "left").where("size > 1 or links > 0")
    marked = marked.select("h0", "h1", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("later", F.lit(False)).alias("later"))
    first = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("line") == F.col("first.line"))
    own = line_keys.select("doc", "version", "line", "h0", "h1").join(marked, ["h0", "h1"])
    return own.select("doc", "version", "line", "links", (F.col("later") | ~first).alias("removed")).where("removed or links > 0")


def _per_document(docs: DataFrame) -> DataFrame:
    """``doc``, ``version``, the places of removed lines and the number of links."""
    hit = decisions(docs).distinct()
    places = F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line"))))
    return hit.groupBy("doc", "version").agg(places.alias("removed"), F.sum("links").alias("n_links"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines``, ``n_removed``, ``n_links`` and a digest of the removed lines' places."""
    found = _per_document(docs)
    base = docs.select("doc_id", digest128(F.col("text")).alias("version"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n"), F.col("text").isNull().alias("none"))
    got = base.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (base.version == found.version), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return got.select("doc_id", F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.sha2(F.array_join(removed, ",").cast("binary"), 256).alias("removed_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents without the removed lines, with the columns of ``docs``."""
    found = _per_document(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), digest128(F.col("text")).alias("v"), F.split("text", "\n").alias("body"))
    got = rows.join(found, F.col("i").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")), "left")
    kept = F.filter("body", lambda _, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return got.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
