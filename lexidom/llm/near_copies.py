"""Near copies of whole documents, by an exact set-similarity join and by SimHash.

A document is the set of its five-word shingles. Shingles are ordered by rarity;
two documents with Jaccard similarity of at least t share one within their first
n - ceil(t n) + 1, so only those are join keys. Equal sets are one class first. Each
class is then held against one other, the first or last class of most of its keys,
which links dense groups in linear work. Shingles that still join different components
are met again. Of these, the ones of more than DENSE classes move behind all others in
the order, which each class has spare shingles for, so a meeting's size is bounded by
DENSE times its rows. A class whose spare shingles don't suffice meets all classes by its
first keys, dense ones too. Pairs are bounded by the number of shared keys and their
places. Jaccard is verified on the whole sets, which are read for candidates only.

Sets don't tell how often a shingle comes, so texts that are mostly repeats of the same words
are found by the operator of ``simhash.py``: fingerprints over five-word shingles, its tree and
components. A text is linked to its component's first one (by hash) if the cosine of their shingle
counts, which fingerprints estimate, is at least t, as fingerprints of short texts can be close by chance. A radius for
Jaccard 0.8 would be some ten of 64 bits, which no tree prunes, so the join is needed too.
One row stays of each component of both kinds of links.

Defined cases: texts without words are copies of one another; null doc_ids come
last; of repeated rows one stays; other columns are kept; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import released, shuffle_partitions, stage
from .common import text_key
from .decontaminate import SHINGLE, shingles
from .lines import _hint, _ordered, _rarity
from .simhash import components, near_duplicates

SIMILARITY = 0.8
#: A shingle of more classes than this is no key where a class has others.
DENSE = 16
#: A class holds twice the keys that it needs and so many more.
SPARE = 8
_NONE = "array<bigint>"


def _sets(docs: DataFrame, *keep) -> DataFrame:
    """``keep`` and words: the sorted distinct shingle hashes of each text."""
    words = F.sort_array(F.array_distinct(F.coalesce("hashes", F.array().cast(_NONE))))
    names = [c for c in shingles(docs, "text", *keep).columns if c != "hashes"]
    return shingles(docs, "text", *keep).select(*names, words.alias("words"))


def _prefix(n, t: float):
    """How many of the rarest of n shingles are keys."""
    return n - F.ceil(n * F.lit(t) - 1e-9).cast("int") + 1


def _held(n, t: float):
    """How many of them a class holds, those to spare included."""
    return F.least(n, _prefix(n, t) * 2 + SPARE)


def _set_hashes() -> list[Column]:
    """Two hashes of a set, which name its class."""
    return [F.xxhash64("words").alias("set1"), F.xxhash64(F.lit(5), F.col("words"), F.lit(9)).alias("set2")]


def _classes(docs: DataFrame, t: float) -> DataFrame:
    """The different sets: cid, set1, set2, first (its first document), n, keys (its rarest shingles, with spare ones)."""
    sets = _sets(docs, docs["doc_id"], *text_key(docs["text"]))
    rarity = _rarity(sets)
    n = F.size("words")
    order = F.transform("words", lambda h: _ordered(rarity, h))
    rows = sets.select(
        "doc_id", "key1", "key2", *_set_hashes(), n.alias("n"),
        F.slice(F.sort_array(order), F.lit(1), _held(n, t)).alias("keys"),
    )
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key1", "key2")
    classes = rows.groupBy("set1", "set2").agg(
        F.min(member).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    return stage(classes.withColumn("cid", F.monotonically_increasing_id()), "shingle-classes")


def _edges(pairs: DataFrame, classes: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """a, b of the pairs (cid, other) that reach the similarity."""
    pairs = stage(pairs, "copy-pairs")
    asked = pairs.select("cid").union(pairs.select("other")).distinct()
    places = stage(
        classes.join(asked, "cid").select("cid", *[F.col(f"first.{c}").alias(f"_{c}") for c in ("doc_id", "key1", "key2")]),
        "copy-places",
    )
    marked = docs.select("doc_id", "text", *text_key(docs["text"]))
    texts = marked.join(
        _hint(places, 64),
        marked["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2")),
    ).dropDuplicates(["cid"]).select("cid", "text")
    sets = stage(_sets(texts, F.col("cid")), "copy-sets")
    # small pairs travel to the sets, so only one set of each pair is shuffled
    ends = pairs.select("other").distinct()
    both = sets.join(_hint(pairs, 24), "cid").join(
        sets.select(F.col("cid").alias("other"), F.col("words").alias("words_")).join(_hint(ends, 16), "other"), "other"
    )
    shared = F.size(F.array_intersect("words", "words_"))
    every = F.size("words") + F.size("words_") - shared
    found = both.where(shared >= every * F.lit(t) - 1e-9)
    return stage(found.select(F.col("cid").alias("a"), F.col("other").alias("b")), "copy-edges")


def _rooted(cids: DataFrame, edges: DataFrame) -> DataFrame:
    """``cids`` with ``root``, the smallest cid of its component."""
    found = stage(components(edges), "copy-roots")
    return cids.join(_hint(found, 24), F.col("cid") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "cid")
    ).drop("node")


def linked(classes: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """a, b: links of classes that join all those with a similar pair between them."""
    def n(c):
        return F.shiftright(c, 32).cast("int")

    def i(c):
        return F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

    def alike(n, n_):
        return (n_ >= n * F.lit(t) - 1e-9) & (n >= n_ * F.lit(t) - 1e-9)

    def wanted(n, n_):
        return F.ceil((n + n_) * F.lit(t / (1 + t)) - 1e-9)

    def packed(n, i):
        """One long holds the number of shingles and the place of the key among them."""
        return F.shiftleft(n.cast("bigint"), 32).bitwiseOR(i.cast("bigint")).alias("at")

    every = classes.select("cid", "n", F.posexplode("keys").alias("i", "word"))
    dealt = every.select("word", "cid", packed(F.col("n"), F.col("i"))).repartition(shuffle_partitions(docs.sparkSession), "word")
    one = F.struct("cid", "at")
    ends = dealt.groupBy("word").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo.cid < hi.cid")
    shared = stage(
        dealt.join(ends, "word").select(
            "word", "cid", "at", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("lo", "hi") for c in ("cid", "at")]
        ),
        "shared-shingles",
    )

    def to(end):
        there = f"{end}_at"
        near = alike(n("at"), n(there)) & (
            F.least(n("at") - i("at"), n(there) - i(there)) >= wanted(n("at"), n(there))
        )
        key = i("at") < _prefix(n("at"), t)
        return shared.where((F.col("cid") != F.col(f"{end}_cid")) & key & near).select("cid", F.col(f"{end}_cid").alias("other"))

    # each class is held against the end that it shares most keys with; the rest is left to the second pass
    votes = to("lo").union(to("hi")).groupBy("cid", "other").count()
    best = votes.groupBy("cid").agg(F.max(F.struct("count", "other")).alias("best"))
    first = _edges(best.select("cid", "best.other"), classes, docs, t)

    # a word of one component only has no pair left to find
    rooted = _rooted(shared.select("word", "cid", "at"), first)
    roots = rooted.groupBy("word").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), (F.count("*") > DENSE).alias("dense")
    )
    mixed = stage(roots.where("lo < hi").select("word", "dense"), "mixed-words")
    left = stage(rooted.join(_hint(mixed, 16), "word"), "mixed-shingles")
    # dense ones go to the end of the order, so the places behind them move up
    gaps = left.where("dense").groupBy("cid").agg(F.collect_list(i("at")).alias("gaps"))  # of one class's keys
    behind = F.coalesce("gaps", F.array().cast("array<int>"))
    before = F.size(F.filter(behind, lambda gap: gap < i("at")))
    keys = _prefix(n("at"), t)
    placed = stage(
        left.join(gaps, "cid", "left").select(
            "word", "cid", "root", "at", "dense", (i("at") < keys).alias("early"),
            packed(n("at"), i("at") - before).alias("moved"), (i("at") - before < keys).alias("key"),
            (_held(n("at"), t) - F.size(behind) < keys).alias("short"),
        ),
        "placed-shingles",
    )

    def meet(ones, others, once):
        other = others.select("word", *[F.col(c).alias(f"{c}_") for c in ("cid", "at", "root", "short")])
        return ones.join(other, "word").where(once & (F.col("root") != F.col("root_")) & alike(n("at"), n("at_"))).select(
            "cid", "cid_", *[f(c).alias(d) for f, c, d in ((n, "at", "n"), (n, "at_", "n_"), (i, "at", "i"), (i, "at_", "i_"))]
        )

    later = F.col("cid_") < F.col("cid")
    moved = placed.where("key and not dense and not short").select("word", "cid", "root", F.col("moved").alias("at"), "short")
    early = placed.where("early").select("word", "cid", "root", "at", "short")
    met = meet(moved, moved, later).union(
        meet(early.where("short"), early, (F.col("cid") != F.col("cid_")) & (~F.col("short_") | later))
    )
    # shared shingles that are no common keys come after the last common key in both orders,
    # and after all keys of the one whose keys end first
    a, b = F.col("n"), F.col("n_")
    rest = met.groupBy("cid", "cid_", "n", "n_").agg(
        F.count("*").alias("c"), F.max("i").alias("i"), F.max("i_").alias("i_")
    ).where(
        (F.col("c") + F.least(a - F.col("i"), b - F.col("i_")) - 1 >= wanted(a, b))
        & (F.col("c") + F.greatest(a - _prefix(a, t), b - _prefix(b, t)) >= wanted(a, b))
    )
    return first.union(_edges(rest.select("cid", F.col("cid_").alias("other")), classes, docs, t))


def _close(rooted: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """a, b: roots of classes that hold texts of one component of fingerprints, where the shingle counts agree.

    ``rooted`` has set1, set2 and root of the classes; what it joins already isn't counted.
    """
    # a text's hash stands for its id, which may be of any type
    found = near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text"), SHINGLE)
    # copies of a component's first text are of its class
    apart = found.select("key", F.col("first.key").alias("other")).where("key != other").distinct()
    apart = stage(apart, "close-texts")

    def texts(pairs):
        asked = stage(pairs.select("key").union(pairs.select("other")).distinct(), "close-keys")
        keyed = docs.select(F.xxhash64("text").alias("key"), "text")
        return keyed.join(_hint(asked, 16), "key").dropDuplicates(["key"])

    def to_other(df, *columns):
        return df.select(F.col("key").alias("other"), *[F.col(c).alias(f"{c}_") for c in columns])

    sets = stage(_sets(texts(apart), F.col("key")).select("key", *_set_hashes()), "close-sets")
    roots = stage(rooted.join(_hint(sets, 32), ["set1", "set2"]).select("key", "root"), "close-roots")
    pairs = apart.join(_hint(roots, 24), "key").join(_hint(to_other(roots, "root"), 24), "other")
    pairs = stage(pairs.where("root != root_"), "close-pairs")
    words = shingles(texts(pairs), "text", F.col("key")).select("key", F.explode("hashes").alias("word"))
    counts = stage(words.groupBy("key", "word").agg(F.count("*").cast("double").alias("n")), "close-counts")
    norms = counts.groupBy("key").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    shared = pairs.join(counts, "key").join(
        counts.select(F.col("key").alias("other"), "word", F.col("n").alias("n_")), ["other", "word"]
    ).groupBy("key", "other", "root", "root_").agg(F.sum(F.col("n") * F.col("n_")).alias("dot"))
    alike = shared.join(norms, "key").join(to_other(norms, "norm"), "other").where(
        F.col("dot") >= F.col("norm") * F.col("norm_") * F.lit(t) - 1e-9
    )
    return stage(alike.select(F.col("root").alias("a"), F.col("root_").alias("b")).distinct(), "close-links")


def keep_first_alike(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row left of each component of similar texts, the one with the smallest doc_id."""
    key1, key2 = text_key(docs["text"])
    with released(docs.sparkSession):
        classes = _classes(docs, similarity)
        rooted = _rooted(classes.select("cid", "first", "set1", "set2"), linked(classes, docs, similarity))
        rooted = stage(rooted.select("set1", "set2", "first", "root"), "copy-components")
        groups = rooted.groupBy(F.col("root").alias("cid")).agg(F.min("first").alias("first"))
        rooted = _rooted(groups, _close(rooted, docs, similarity))
        kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(
            F.col("first.doc_id").alias("_id"), F.col("first.key1").alias("_key1"), F.col("first.key2").alias("_key2")
        )
        kept = stage(kept, "kept", lasting=True)
    kept = _hint(kept, 48)
    marked = docs.withColumns({"_doc1": key1, "_doc2": key2})
    out = marked.join(
        kept,
        marked["doc_id"].eqNullSafe(kept["_id"]) & (marked["_doc1"] == kept["_key1"]) & (marked["_doc2"] == kept["_key2"]),
        "left_semi",
    ).drop("_doc1", "_doc2")
    repeated = docs.groupBy("doc_id", key1, key2).count().where("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
