"""Line dedup by an exact set-similarity join.

A line is the set of its lower-case words. Words are ordered by rarity (counted by
hash bucket over the whole table); two lines with Jaccard similarity of at least t
share a word within their first n - ceil(t n) + 1 words, so only those words are
join keys. Length and positional filters act inside the join, and so does a
parity sketch: words toggle bits of one long, in long sets of two, and the bits in
which two sketches differ are at most the words in which the sets do. Jaccard is
verified on the whole sets. A line goes if an earlier line (by doc_id, then line)
is similar to it, kept or not.

Equal sets are one class first. Then each class meets only the earliest class of
each of its key words of many classes, which settles dense groups of copies in linear
work. Then all classes are dealt by their key words once, and each meets those no longer
than itself, unless both are settled; which of the two is the later is decided with
the verification. Key words travel as 32 bits, which can only add candidates; whole sets are read for the verification, of candidates only.
Texts are split into words once; later steps read the sets' hashes from a table.

All of it is DataFrame operations. What is broadcast is measured first; beyond the
bound the same joins shuffle.

Defined cases: null texts have no lines and stay null; lines without words are
never removed; null doc_ids come last; rows with equal doc_id are told apart by
their texts; repeated rows are one document, so they keep the same lines; empty
tables give none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import released, scratch_path, shuffle_partitions, stage
from .common import plain_words, small, text_key

SIMILARITY = 0.8
#: Words are counted in this many hash buckets (a power of two), whatever the table.
RARITY_BUCKETS = 1 << 16
#: A file's words are written as a dictionary of up to this size; a matter of space only.
_DICTIONARY_BYTES = 16 << 20
#: A key word of more classes than this first meets its earliest class only.
DENSE = 256
#: Sets of at least this many words carry a second parity sketch.
LONG = 64
_LAST = (1 << 63) - 1
_PLACE = ["doc", "key1", "key2", "line_no"]


def _hint(df: DataFrame, bytes_per_row: int) -> DataFrame:
    return F.broadcast(df) if small(df, bytes_per_row) else df


def _lines(docs: DataFrame) -> DataFrame:
    """doc, key1, key2, line_no, line."""
    # the keys come first: beside the explode they would be made anew for each line
    keyed = docs.select(F.coalesce(docs["doc_id"], F.lit(_LAST)).alias("doc"), *text_key(docs["text"]), "text")
    return keyed.select("doc", "key1", "key2", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _hashes(line: Column) -> Column:
    return F.array_distinct(F.transform(plain_words(line), lambda w: F.xxhash64(w)))


def _bucket(h):
    return h.bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int")


def _line_sets(docs: DataFrame) -> DataFrame:
    """Place, set1, set2 (hashes of the set) and words (sorted hashes) of each line with words.

    Texts are split into words here and nowhere else. Words repeat over lines, so the
    table's dictionaries hold far fewer of them than its rows do.
    """
    words = _lines(docs).select(*_PLACE, F.sort_array(_hashes(F.col("line"))).alias("words"))
    sets = words.select(
        *_PLACE, F.xxhash64("words").alias("set1"),
        F.xxhash64(F.lit(5), F.col("words"), F.lit(9)).alias("set2"), "words",
    )
    path = scratch_path(docs.sparkSession, "line-sets")
    sets.write.option("parquet.dictionary.page.size", _DICTIONARY_BYTES).parquet(path)
    # only here: a filter before the writing would split the texts once more
    return docs.sparkSession.read.schema(sets.schema).parquet(path).where(F.size("words") > 0)


def _rarity(sets: DataFrame) -> Column:
    """An array with twice the binary logarithm of each bucket's count, as a constant."""
    counts = sets.select(F.explode("words").alias("w")).groupBy(_bucket(F.col("w")).alias("b")).count()
    levels = ["0"] * RARITY_BUCKETS
    for r in counts.collect():  # RARITY_BUCKETS rows at most
        levels[r.b] = str(min(127, int(2 * math.log2(r["count"]))))
    return F.split(F.lit(",".join(levels)), ",").cast("array<bigint>")


def _ordered(rarity: Column, h: Column) -> Column:
    """The hash with its bucket's level in the top byte: rare ones first."""
    return F.shiftleft(F.get(rarity, _bucket(h)), 56).bitwiseOR(F.shiftrightunsigned(h, 8))


def _parity(words: Column) -> Column:
    """Each word toggles one of 64 bits."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    bit = lambda w: F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(words, zero, lambda bits, w: bits.bitwiseXOR(bit(w)))


def _keyed(sets: DataFrame, rarity: Column, t: float) -> DataFrame:
    """Per line: place, set1, set2, n, all_bits, odd_bits (parity), keys (the rarest words, 32 bits).

    ``odd_bits`` is the parity of about half of the words, of long sets only.
    """

    def key(w):
        return (w.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")

    n = F.size("words")
    length = n - F.ceil(n * F.lit(t) - 1e-9).cast("int") + 1
    rarest = F.slice(F.sort_array(F.transform("words", lambda h: _ordered(rarity, h))), F.lit(1), length)
    odd = _parity(F.filter("words", lambda w: w.bitwiseAND(F.lit(64)) != 0))
    return sets.select(
        *_PLACE, "set1", "set2", n.alias("n"), _parity(F.col("words")).alias("all_bits"),
        F.when(n >= LONG, odd).otherwise(F.lit(0).cast("bigint")).alias("odd_bits"),
        F.transform(rarest, key).alias("keys"),
    )


def _candidates(left: DataFrame, right: DataFrame, t: float, once: Column) -> DataFrame:
    """(cid, other) of rows with a common key word that pass the filters and ``once``.

    Rows are cid, at (n, position and mark in one long), all_bits, odd_bits, word;
    the other side's names end in _.
    """
    n, n_ = (F.shiftright(c, 32) for c in ("at", "at_"))
    i, i_ = (F.shiftright(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), 1) for c in ("at", "at_"))
    wanted = F.ceil((n + n_) * F.lit(t / (1 + t)) - 1e-9)
    whole = F.col("all_bits").bitwiseXOR(F.col("all_bits_"))
    odd = F.col("odd_bits").bitwiseXOR(F.col("odd_bits_"))
    differ = F.when(F.least(n, n_) < LONG, F.bit_count(whole)).otherwise(
        F.bit_count(whole.bitwiseXOR(odd)) + F.bit_count(odd)
    )
    near = (
        (n_ >= n * F.lit(t) - 1e-9) & (n >= n_ * F.lit(t) - 1e-9)
        & (F.least(n - i, n_ - i_) >= wanted) & (differ <= n + n_ - 2 * wanted)
    )
    return left.join(right, "word").where(once & near).select("cid", F.col("cid_").alias("other"))


def _verified(pairs: DataFrame, classes: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """cid of the later class of each pair (cid, other) that reaches the similarity."""
    pairs = stage(pairs.distinct(), "line-pairs")
    asked = pairs.select("cid").union(pairs.select("other")).distinct()
    places = stage(classes.select("cid", "first.*").join(asked, "cid"), "line-places")
    place = F.struct("doc", "line_no", "key1", "key2").alias("place")
    sets = stage(
        lines.join(_hint(places, 64), _PLACE).select("cid", place, "words").dropDuplicates(["cid"]),
        "asked-sets",
    )
    both = pairs.join(sets, "cid").join(
        sets.select(*[F.col(c).alias(d) for c, d in (("cid", "other"), ("place", "place_"), ("words", "words_"))]),
        "other",
    )
    shared = F.size(F.array_intersect("words", "words_"))
    every = F.size("words") + F.size("words_") - shared
    later = F.when(F.col("place") > F.col("place_"), F.col("cid")).otherwise(F.col("other"))
    return stage(both.where(shared >= every * F.lit(t) - 1e-9).select(later.alias("cid")).distinct(), "similar")


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc (null doc_ids as the largest long), key1, key2 (of the text), line_no: lines to remove."""
    t = similarity
    lines = _line_sets(docs)
    keyed = _keyed(lines, _rarity(lines), t)
    place = F.struct("doc", "line_no", "key1", "key2")
    carried = ["n", "all_bits", "odd_bits", "keys"]
    classes = stage(
        keyed.groupBy("set1", "set2")
        .agg(F.min(place).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in carried])
        .withColumn("cid", F.monotonically_increasing_id()),
        "line-classes",
    )
    names = ["cid", "at", "all_bits", "odd_bits"]
    other = [F.col(c).alias(f"{c}_") for c in names]

    def rows(of, mark, *more):
        at = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR((F.col("i") * 2 + mark).cast("bigint"))
        every = of.select("*", F.posexplode("keys").alias("i", "word"))
        return every.select("word", "cid", at.alias("at"), "all_bits", "odd_bits", *more)

    plain = rows(classes, F.lit(0), "first")
    dense = stage(plain.groupBy("word").count().where(F.col("count") > DENSE).select("word"), "dense")
    often = plain.join(_hint(dense, 16), "word")
    earliest = F.min(F.struct("first.doc", "first.line_no", *names)).alias("o")
    anchors = stage(
        often.groupBy("word").agg(earliest).select("word", *[F.col(f"o.{c}").alias(f"{c}_") for c in names]),
        "anchors",
    )
    apart = F.col("cid") != F.col("cid_")
    settled = _verified(
        _candidates(often.drop("first"), _hint(anchors, 64), t, apart), classes, lines, t
    )

    marked = classes.join(_hint(settled.withColumn("mark", F.lit(1)), 24), "cid", "left")
    dealt = rows(marked, F.coalesce("mark", F.lit(0))).repartition(shuffle_partitions(docs.sparkSession), "word")
    n, n_ = (F.shiftright(c, 32) for c in ("at", "at_"))
    shorter = (n_ < n) | ((n_ == n) & (F.col("cid_") < F.col("cid")))
    both_settled = F.col("at").bitwiseAND(F.col("at_")).bitwiseAND(F.lit(1)) == 1
    rest = _verified(
        _candidates(dealt, dealt.select("word", *other), t, shorter & ~both_settled), classes, lines, t
    )
    similar = settled.union(rest).distinct().withColumn("similar", F.lit(True))

    verdict = stage(
        classes.select("cid", "set1", "set2", "copies", "first").join(similar, "cid", "left")
        .where("copies > 1 or similar")
        .select("set1", "set2", F.coalesce("similar", F.lit(False)).alias("similar"), "first"),
        "line-verdicts",
    )
    repeats = F.struct("doc", "line_no", "key1", "key2") != F.col("first")
    found = lines.select(*_PLACE, "set1", "set2").join(_hint(verdict, 80), ["set1", "set2"])
    return found.where(F.col("similar") | repeats).select(*_PLACE).distinct()


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, and ``removed``, their numbers from 0."""
    with released(docs.sparkSession):
        gone = stage(
            removed_lines(docs, similarity)
            .groupBy("doc", "key1", "key2")
            .agg(F.collect_set("line_no").alias("_gone")),  # lines of one document
            "removed-lines", lasting=True,
        )
    size = gone.agg(F.coalesce(F.sum(F.size("_gone") * 8 + 64), F.lit(0))).first()[0]
    if size <= 64 << 20:
        gone = F.broadcast(gone)
    key1, key2 = text_key(docs["text"])
    marked = docs.withColumns(
        {"_doc": F.coalesce(docs["doc_id"], F.lit(_LAST)), "_key1": key1, "_key2": key2}
    )
    joined = marked.join(
        gone,
        (marked["_doc"] == gone["doc"]) & (marked["_key1"] == gone["key1"]) & (marked["_key2"] == gone["key2"]),
        "left",
    )
    stay = F.filter(
        F.split(docs["text"], "\n"), lambda _, i: ~F.array_contains(F.col("_gone"), i)
    )
    text = F.when(F.col("_gone").isNull(), docs["text"]).otherwise(F.array_join(stay, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.coalesce(F.sort_array("_gone"), F.array().cast("array<int>")).alias("removed"),
    )
