"""Labelled JSON-lines log: scan, and the parse of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import encode_threat, stripped
from ..schema import RAW_LOG_DDL
from ..session import fits_broadcast, spread

_CORRUPT = "_corrupt_record"


def parse_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Keep the well-formed records of ``lines`` as domain, threat, label.

    Blank lines, ``#`` comments, broken JSON, JSON that is no object, and
    records without a domain or threat are dropped. Other columns ride along.
    """
    line = stripped(F.col(line_col))
    record = F.from_json(
        line,
        f"{RAW_LOG_DDL}, {_CORRUPT} STRING",
        {"columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"},
    )
    rest = [c for c in lines.columns if c != line_col]
    return (
        # Only a line that is one object from end to end can be a record.
        lines.where(line.startswith("{") & line.endswith("}"))
        # As a generator the parse runs once; as a plain column, the filters
        # below would each be pushed under it with a parse of their own.
        .select(*rest, F.inline(F.array(record)))
        .where(F.col(_CORRUPT).isNull())
        .where("domain <> '' and threat <> ''")
        .drop(_CORRUPT)
        .withColumn("label", encode_threat(F.col("threat")))
    )


def fold_lines(lines: DataFrame, order: str, line_col: str = "value") -> DataFrame:
    """One row per different line, with its smallest ``order``: equal lines parse alike."""
    return lines.groupBy(line_col).agg(F.min(order).alias(order))


def count_raw_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """domain, threat, label and n, the log's lines with that record, however they are spelled.

    The log is read once: no line needs its place. Equal lines are folded before they are
    parsed, those of a task before they are shuffled.
    """
    lines = spark.read.text(path).groupBy("value").agg(F.count("*").alias("_lines"))
    return parse_lines(lines).groupBy("domain", "threat", "label").agg(F.sum("_lines").alias("n"))


def read_raw_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scan plain or compressed JSON lines into domain, threat, label, ord.

    ``ord`` grows in file order: by path, then place in the file, however files
    are packed into tasks; it has gaps. One gzip file is one scan task whatever
    its size, so ship the log as many files (or a splittable codec) at scale; the
    lines of too few files are spread before they are parsed. A missing path
    raises Spark's own PATH_NOT_FOUND error.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),  # grows within a task, so within a split
    )
    # one row per split of a file
    splits = lines.select("_file", "_start").distinct()
    number = F.row_number().over(Window.orderBy("_file", "_start")) - 1
    splits = splits.withColumn("_split", number.cast("bigint"))
    if fits_broadcast(splits, "_file"):
        splits = F.broadcast(splits)
    in_split = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = spread(lines, "_id").join(splits, ["_file", "_start"])
    return parse_lines(placed.select("value", (F.shiftleft("_split", 33) + in_split).alias("ord")))


def write_raw_log(df: DataFrame, path: str, line_col: str = "value") -> None:
    df.select(F.col(line_col).alias("value")).write.option("compression", "gzip").text(path)
