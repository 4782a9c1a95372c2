"""Documents that hold test items, by size-partitioned MinHash containment search.

Items fall into size classes (powers of two of their distinct word shingles). An
item's sketch is its bottom-k MinHash: the k shingles with the smallest hashes,
where k of its class is one more than the shingles that a match may lack. A
document that holds the wanted share of an item holds a sketch shingle
(pigeonhole), however long the document is; a class is searched only in documents
large enough for it. Exact containment over all shingles of the pairs found decides.

All of it is DataFrame operations; document rows are shuffled only after they
have met a sketch shingle.

Defined cases: null and wordless texts and items have no shingles and match
nothing; texts shorter than a shingle are one shingle; long texts are searched whole; repeated items or documents
(same id and text) give one row; null ids are kept apart by their texts; other
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import plain_words, small, text_key

SHINGLE = 5
CONTAINMENT = 0.8


def shingles(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep``, hashes (array): a hash of each run of SHINGLE words, null without words."""

    def runs(w):
        n = F.size(w)
        each = F.transform(
            F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[w[i + j] for j in range(SHINGLE)])
        )
        return F.when(n >= SHINGLE, each).when(n > 0, F.array(F.xxhash64(w)))

    words = F.transform(plain_words(df[text]), lambda w: F.xxhash64(w))
    # an array of one binds the words, which would else be made anew for each run
    return df.select(*keep, F.transform(F.array(words), runs)[0].alias("hashes"))


def item_sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, item1, item2, n_item, least_doc, hash, in_sketch: one row per distinct shingle."""
    key1, key2 = text_key(items["text"])
    rows = shingles(items, "text", items["item_id"], key1.alias("item1"), key2.alias("item2"))
    distinct = rows.select(
        "item_id", "item1", "item2", F.explode(F.array_distinct("hashes")).alias("hash")
    ).distinct()
    sizes = distinct.groupBy("item_id", "item1", "item2").agg(
        F.count("*").alias("n_item"), F.sort_array(F.collect_list(F.xxhash64("hash"))).alias("orders")
    )  # an item is one short text, so its list is bounded by that text
    # the class upper bound gives the number of shingles that may be missing
    top = F.pow(F.lit(2), F.ceil(F.log2("n_item")))
    k = F.least(F.col("n_item"), F.floor(top * F.lit(round(1 - containment, 9))) + 1)
    sizes = sizes.withColumn("bar", F.element_at("orders", k.cast("int"))).drop("orders")
    return (
        distinct.withColumn("id", F.struct("item_id", "item1", "item2"))
        .join(
            sizes.select(F.struct("item_id", "item1", "item2").alias("id"), "n_item", "bar"), "id"
        )
        .select(
            "item_id", "item1", "item2", "n_item",
            F.ceil(F.col("n_item") * F.lit(containment) - 1e-9).alias("least_shared"),
            "hash", (F.xxhash64("hash") <= F.col("bar")).alias("in_sketch"),
        )
    )


def candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """doc_id, key1, key2, item: documents that hold a sketch shingle of an item and are large enough for it."""
    wanted = sketches.where("in_sketch").select("item", "least_shared", "hash")
    if small(wanted, 96):
        wanted = F.broadcast(wanted)
    rows = shingles(docs, "text", docs["doc_id"], *text_key(docs["text"]))
    each = rows.select("doc_id", "key1", "key2", F.size("hashes").alias("n_doc"), F.explode("hashes").alias("hash"))
    met = each.join(wanted, "hash").where("n_doc >= least_shared")
    return met.select("doc_id", "key1", "key2", "item").distinct()


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, key1, key2, item_id, n_item, n_shared, containment: one row for each document
    and item of which the document holds at least ``containment`` of the shingles.

    The sketches find the pairs; only the texts of pairs are read again, once each, and
    their whole shingle sets are held against the items'.
    """
    item = F.struct("item_id", "item1", "item2").alias("item")
    sketches = stage(item_sketches(items, containment).select(item, "n_item", "least_shared", "hash", "in_sketch"), "sketches")
    pairs = stage(candidates(docs, sketches), "pairs")
    by_text = pairs.select("key1", "key2", "item").distinct()
    found = by_text.select(F.col("key1").alias("_key1"), F.col("key2").alias("_key2")).distinct()
    key1, key2 = text_key(docs["text"])
    keyed = docs.select("text", key1, key2).join(
        F.broadcast(found) if small(found, 32) else found,
        (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2")), "left_semi",
    ).dropDuplicates(["key1", "key2"])
    texts = shingles(keyed, "text", keyed["key1"], keyed["key2"])
    sets = sketches.groupBy("item", "n_item", "least_shared").agg(F.collect_list("hash").alias("all"))  # of one short text each
    if small(sketches, 32):
        sets = F.broadcast(sets)
    shared = F.size(F.array_intersect("hashes", "all")).cast("bigint")
    held = (
        by_text.join(sets, "item").join(texts, ["key1", "key2"])
        .withColumn("n_shared", shared).where("n_shared >= least_shared")
        .select("key1", "key2", "item", "n_item", "n_shared")
    )
    return pairs.join(held, ["key1", "key2", "item"]).select(
        "doc_id", "key1", "key2", "item.item_id", "n_item", "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def without_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    found = contained(docs, items, containment).select(
        F.col("key1").alias("_key1"), F.col("key2").alias("_key2")
    ).distinct()
    key1, key2 = text_key(docs["text"])
    marked = docs.withColumns({"_doc1": key1, "_doc2": key2})
    return marked.join(
        found, (marked["_doc1"] == found["_key1"]) & (marked["_doc2"] == found["_key2"]), "left_anti"
    ).drop("_doc1", "_doc2")
