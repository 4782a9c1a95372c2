"""Inputs that the given tables do not hold, derived from them by Spark.

Benign domains are the distinct words of all documents; each also gives one
generated-looking twin from its hash. The dictionary is learned from the
English documents. Everything is a function of whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import distinct_tokens
from ..operators.cleaning import dedup_benign_wins, merge_classes
from ..operators.ordering import assign_ord
from ..operators.reference_tables import (
    Lexicon, build_lexicon, dictionary_from_texts, fit_trigrams,
)
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def generated_twin(word: str = "domain"):
    """A hash of the word, mostly letters, about as long as the word."""
    return F.expr(
        f"translate(substring(md5({word}), 1, greatest(length({word}), 6)), '01234567', 'ghijklmn')"
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, label: benign words and generated twins, one row per domain."""
    texts = documents(spark, sf_dir).select(F.explode(distinct_tokens(F.col("text"))).alias("domain"))
    benign = texts.distinct()
    both = merge_classes(
        benign.withColumn("label", F.lit(0)),
        benign.select(generated_twin().alias("domain"), F.lit(1).alias("label")),
    )
    return dedup_benign_wins(both.select("domain", "label"))


def ordered_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_ord(domains(spark, sf_dir), ["domain"])


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the English documents."""
    return dictionary_from_texts(documents(spark, sf_dir).where("lang = 'en'"))


def lexicon(spark: SparkSession, sf_dir: str, labelled: DataFrame) -> Lexicon:
    return build_lexicon(dictionary(spark, sf_dir), fit_trigrams(labelled))
