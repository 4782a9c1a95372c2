"""Mixing sources to target weights by nested hash thresholds.

Every document has a hash; a source takes whole passes over its documents and,
for the rest of its budget, the documents below a hash threshold. The threshold
is found from sums per source and hash bucket; only the bucket it falls in is
summed again, eight bits finer, until no bucket is open. Nothing is sorted, and
a smaller budget takes a subset of a larger one.

Defined cases: null text has size 0; a null source is a source, last in order;
rows with equal doc_id and text share a hash and are taken or left together;
an empty table gives none. Other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import fits_broadcast, stage

HASH_BITS, STEP = 56, 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def place(*columns: Column) -> Column:
    """A hash of 56 bits as a non-negative long, equal in other engines."""
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in columns]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights=(5, 2, 1), total_share: float = 1.5, most: int = 2) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size).

    Weights repeat over the sources in code-point order, null last. A source takes at
    most ``most`` times its size; what is over goes to the others by weight. Sources
    whose limit lies below the common level come first by limit over weight, so one
    running sum over the sources finds them all.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = (
        sources.withColumn("rank", rank)
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("budget", F.sum("source_size").over(whole).cast("double") * total_share)
        .withColumn("open_w", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("full", F.col("limit") * F.col("open_w") <= F.col("weight") * F.col("left"))
    )
    spent = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(whole)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)
    level = (F.col("budget") - spent) / F.when(open_weight > 0, open_weight)
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def _named(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("+"), source), F.lit(""))


def _sized(docs: DataFrame, *keep: Column) -> DataFrame:
    text = docs["text"]
    return docs.select(
        *keep,
        _named(docs["source"]).alias("mix_name"),
        word_count(text).alias("mix_size"),
        place(docs["doc_id"], F.md5(F.coalesce(text, F.lit("")))).alias("mix_place"),
    )


def thresholds(docs: DataFrame, weights=(5, 2, 1), total_share: float = 1.5, most: int = 2) -> DataFrame:
    """name, source_size, target, passes, rest, low: one row per source.

    A source is taken ``passes`` times whole, and once more below hash ``low``.
    """
    sized = stage(_sized(docs, docs["source"]), "sized")
    per_source = sized.groupBy("source", "mix_name").agg(F.sum("mix_size").alias("source_size"))
    size = F.col("source_size")
    passes = sum(
        (F.when(F.col("target") >= size * i, 1).otherwise(0) for i in range(1, most + 1)), F.lit(0)
    )
    bounds = stage(
        targets(per_source, weights, total_share, most)
        .withColumn("name", _named(F.col("source")))
        .withColumn("passes", F.when(size == 0, 0).otherwise(passes))
        .withColumn("rest", F.col("target") - F.col("passes") * size)
        .withColumn("low", F.lit(0).cast("bigint"))
        .drop("source"),
        "bounds",
    )
    hint = _hint(bounds)
    open_rows = sized.select(
        F.col("mix_name").alias("name"), F.col("mix_size").alias("size"), F.col("mix_place").alias("place")
    )
    width = HASH_BITS
    while width > 0:
        span = 1 << (width - STEP)
        sums = (
            open_rows.join(hint(bounds.select("name", "low")), "name")
            .groupBy("name", F.expr(f"(place - low) div {span}").cast("int").alias("bucket"))
            .agg(F.sum("size").alias("size"))
        )
        upto = F.sum("size").over(Window.partitionBy("name").orderBy("bucket"))  # 2^STEP rows
        walk = sums.withColumn("upto", upto).join(hint(bounds.select("name", "rest")), "name")
        # the first bucket that no longer fits; none if all fit
        edge = walk.where("upto > rest").groupBy("name").agg(
            F.min("bucket").alias("bucket"), F.min(F.expr("upto - size")).alias("spent")
        )
        bounds = stage(
            bounds.join(hint(edge), "name", "left").select(
                "name", "source_size", "target", "passes",
                (F.col("rest") - F.coalesce("spent", F.lit(0))).alias("rest"),
                (F.col("low") + F.coalesce(F.expr(f"bucket * {span}L"), F.lit(1 << width))).alias("low"),
            ),
            "bounds",
        )
        width -= STEP
        open_rows = stage(
            open_rows.join(hint(bounds.select("name", "low")), "name")
            .where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.lit(1 << width)))
            .select("name", "size", "place"),
            "boundary",
        )
        ends = open_rows.groupBy("name").agg(F.min("place").alias("a"), F.max("place").alias("b"))
        if ends.where("a < b").limit(1).count() == 0:
            break  # each open bucket holds one hash, and it doesn't fit
    return bounds


def _hint(per_source: DataFrame):
    """One row per source is small, but it is measured before it is hinted."""
    return F.broadcast if fits_broadcast(per_source, "name") else (lambda df: df)


def mix(docs: DataFrame, weights=(5, 2, 1), total_share: float = 1.5, most: int = 2) -> DataFrame:
    """``docs`` and mix_size, mix_source_size, mix_target, mix_copies, mix_taken (words taken,
    repeats counted). Columns of ``docs`` with these names are replaced."""
    bounds = thresholds(docs, weights, total_share, most)
    made = {"mix_name", "mix_size", "mix_place", "mix_source_size", "mix_target", "mix_copies", "mix_taken"}
    keep = [c for c in docs.columns if c not in made]
    rows = _sized(docs, *[docs[c] for c in keep])
    limits = bounds.select(
        F.col("name").alias("mix_limit_of"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), F.col("passes").alias("mix_passes"), F.col("low").alias("mix_low"),
    )
    copies = (F.col("mix_passes") + (F.col("mix_place") < F.col("mix_low")).cast("int")).cast("int")
    return rows.join(_hint(bounds)(limits), F.col("mix_name") == F.col("mix_limit_of")).select(
        *keep, "mix_size", "mix_source_size", "mix_target",
        copies.alias("mix_copies"), (F.col("mix_size") * copies).alias("mix_taken"),
    )
