"""The corpus pipeline: five stages, each over all that the one before kept.

Defined cases are those of the operators; all stages but the last return the columns
of their input, the last adds the mix's columns and drops what the mix doesn't take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexidom.llm.common import table
from lexidom.llm.decontaminate import without_items
from lexidom.llm.language import keep_identified
from lexidom.llm.lines import dedup_lines
from lexidom.llm.mixing import mix
from lexidom.llm.near_copies import keep_first_alike
from lexidom.session import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the texts; ``n_chars``, where there is one, follows."""
    cut = dedup_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        cut = cut.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_alike(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).where("mix_copies > 0")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]
#: SQL can't express the models of the first stage or the components of the third.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
