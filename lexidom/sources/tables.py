"""Readers and writers of the prepared tables. Schemas are never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import stripped
from ..schema import LABELLED_DDL, TRIGRAMS_DDL
from ..session import stage


def write_split(df: DataFrame, path: str, fmt: str = "parquet", split_col: str = "split") -> None:
    """One folder per split value; ``fmt`` is parquet or csv."""
    writer = df.write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        # Quote everything: a domain spelled like a null must stay a string.
        writer = writer.option("header", True).option("quoteAll", True)
    writer.format(fmt).save(path)


def read_split(
    spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet",
    ddl: str = LABELLED_DDL,
) -> DataFrame:
    """Labelled rows, with a partition filter when ``split`` is given."""
    # enforceSchema=False: a CSV whose header disagrees with the DDL is an error.
    reader = spark.read.schema(f"{ddl}, split STRING").option("header", True)
    df = reader.option("enforceSchema", False).format(fmt).load(path)
    return df if split is None else df.where(F.col("split") == split).drop("split")


def read_rescued(
    spark: SparkSession, path: str, ddl: str = LABELLED_DDL, header: bool = False
) -> tuple[DataFrame, DataFrame]:
    """CSV rows that fit the DDL, and the lines that don't (column line), which add up to all rows.

    A line is rejected if a value has the wrong type, or values are missing or too many.
    """
    corrupt = "_corrupt_record"
    reader = spark.read.schema(f"{ddl}, {corrupt} STRING").option("columnNameOfCorruptRecord", corrupt)
    rows = stage(reader.option("header", header).csv(path), "rescued")  # parsed once for both
    good = rows.where(F.col(corrupt).isNull()).drop(corrupt)
    return good, rows.where(F.col(corrupt).isNotNull()).select(F.col(corrupt).alias("line"))


def write_words(words: DataFrame, path: str) -> None:
    words.select("word").orderBy("word").write.mode("overwrite").text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line; white space and blank lines do not count."""
    word = stripped(F.col("value")).alias("word")
    return spark.read.text(path).select(word).where("word <> ''").distinct()


def write_trigrams(trigrams: DataFrame, path: str) -> None:
    trigrams.select("gram", "p").write.mode("overwrite").parquet(path)


def read_trigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIGRAMS_DDL).parquet(path)
