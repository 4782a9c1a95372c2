"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters that separate words in texts matched word by word: ASCII signs and spaces.
ASCII_SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits; null and signs only give none."""
    words = F.array_remove(F.split(F.lower(text), ASCII_SIGNS), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes; equal texts get equal keys, null its own."""
    t = F.coalesce(F.concat(F.lit("t"), text), F.lit("-"))
    return [F.xxhash64(t).alias("key1"), F.xxhash64(F.lit(7), t, F.lit(11)).alias("key2")]


def small(df: DataFrame, bytes_per_row: int, max_bytes: int = 64 << 20) -> bool:
    """Whether a table of rows of bounded width may be broadcast or collected."""
    return df.count() * bytes_per_row <= max_bytes
