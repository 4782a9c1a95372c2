"""Word dictionary and trigram probabilities, learned from tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import distinct_tokens
from ..session import fits_broadcast, stage


def explode_grams(df: DataFrame, domain: str = "domain", size: int = 3) -> DataFrame:
    """One row per character n-gram occurrence; shorter strings give none."""
    starts = F.explode(F.sequence(F.lit(1), F.length(domain) - (size - 1)))
    long_enough = df.where(F.length(domain) >= size)
    gram = F.substring(F.col(domain), F.col("_i"), F.lit(size))
    return long_enough.select("*", starts.alias("_i")).withColumn("gram", gram).drop("_i")


def trigram_table(domains: DataFrame, domain: str = "domain") -> DataFrame:
    """Relative frequency of each trigram over all occurrences.

    Occurrences are folded on the map side; the total comes from the lengths,
    so the exploded rows are only produced once.
    """
    counts = explode_grams(domains.select(domain), domain).groupBy("gram").agg(
        F.count("*").alias("cnt")
    )
    grams_in = F.greatest(F.length(domain) - 2, F.lit(0))
    total = domains.agg(F.sum(grams_in).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(
        "gram", "cnt", (F.col("cnt") / F.col("total")).alias("p")
    )


def fit_trigrams(labelled: DataFrame, fit_on: str = "all") -> DataFrame:
    """Trigram table of the benign rows.

    ``fit_on='all'`` uses every benign row; ``'train'`` only those whose
    ``split`` is train, so that the test rows stay unseen.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
    benign = labelled.where("label = 0")
    return trigram_table(benign if fit_on == "all" else benign.where("split = 'train'"))


def dictionary_from_words(words: DataFrame, word: str = "word") -> DataFrame:
    return words.select(F.lower(word).alias("word")).distinct()


def dictionary_from_texts(
    texts: DataFrame, text: str = "text", min_length: int = 1, min_documents: int = 1
) -> DataFrame:
    """Distinct lower-case words seen in at least ``min_documents`` texts.

    Repeats inside a text are dropped in its own row, so a word costs one
    count per text and the counts are folded before the shuffle.
    """
    seen = texts.select(F.explode(distinct_tokens(F.col(text))).alias("word"))
    return (
        seen.where(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= min_documents)
        .select("word")
    )


@dataclass(frozen=True)
class Lexicon:
    """The two lookup tables of the features.

    ``starts`` is keyed by three characters: the trigram's probability p, and
    the lengths of the words that begin so. It is bounded by the alphabet, and
    tells which of a domain's substrings can be words at all. ``words`` holds
    the words, and the empty string as a row that every domain matches.
    ``short_lengths`` are the word lengths below three that occur.
    """

    starts: DataFrame
    words: DataFrame
    short_lengths: list[int]
    starts_small: bool
    words_small: bool


def build_lexicon(
    dictionary: DataFrame | None, trigrams: DataFrame | None, min_word_len: int = 1
) -> Lexicon:
    """Derive the lookup tables, stage them, and measure them for the joins."""
    spark = (dictionary if dictionary is not None else trigrams).sparkSession
    if dictionary is None:
        dictionary = spark.createDataFrame([], "word STRING")
    if trigrams is None:
        trigrams = spark.createDataFrame([], "gram STRING, p DOUBLE")
    n = F.length("word")
    kept = dictionary.where(n >= max(min_word_len, 1)).select("word").distinct()
    words = stage(
        kept.select(F.col("word").alias("gram"), n.alias("_n")).unionByName(
            spark.createDataFrame([("", 0)], "gram STRING, _n INT")
        ),
        "words",
    )
    begins = (
        words.where("_n >= 3")
        .groupBy(F.substring("gram", 1, 3).alias("gram"))
        .agg(F.sort_array(F.collect_set("_n")).alias("lengths"))
    )
    known = trigrams.where(F.length("gram") == 3).select("gram", "p")
    starts = stage(known.join(begins, "gram", "full_outer"), "starts")
    short = [r["_n"] for r in words.where("_n in (1, 2)").select("_n").distinct().collect()]
    return Lexicon(
        starts, words.select("gram"), sorted(short),
        fits_broadcast(starts, "gram"), fits_broadcast(words, "gram"),
    )
