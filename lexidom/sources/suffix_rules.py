"""Public-suffix rules as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# A small starter list in the public-suffix notation, for when
# no full list file is at hand. Pass a file to read_suffix_rules for real use.
STARTER_RULES = """
com net org edu gov mil int info biz name io co me tv cc us uk de fr es it nl be ch at pl ru cn jp
kr in br au nz ca mx eu se no fi dk cz gr tr za xyz top club online site shop app dev
co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp com.br com.cn com.mx co.in
co.kr co.za com.tr *.ck !www.ck
""".split()


def _parse(lines: DataFrame) -> DataFrame:
    """Fold rules into one row per base name, so a lookup never fans out."""
    text = F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1))
    rules = lines.select(text.alias("text")).where("text <> '' and not startswith(text, '//')")
    base = F.regexp_replace("text", r"^(?:!|\*\.)", "")
    return (
        rules.groupBy(base.alias("rule"))
        .agg(
            F.bool_or(~F.col("text").rlike(r"^(?:!|\*\.)")).alias("plain"),
            F.bool_or(F.startswith("text", F.lit("*."))).alias("wildcard"),
            F.bool_or(F.startswith("text", F.lit("!"))).alias("exception"),
        )
        .withColumn("labels", F.size(F.split("rule", r"\.")))
    )


def read_suffix_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """Rules of a public-suffix list file: rule, plain, wildcard, exception, labels.

    Privately operated suffixes (the marked second section) count only with
    ``private``; the whole file is one small text row while its sections split.
    """
    text = spark.read.text(path, wholetext=True)
    body = F.col("value") if private else F.element_at(
        F.split("value", "===BEGIN PRIVATE DOMAINS==="), 1
    )
    return _parse(text.select(F.explode(F.split(body, r"\r?\n")).alias("value")))


def starter_rules(spark: SparkSession) -> DataFrame:
    return rules_from(spark, STARTER_RULES)


def rules_from(spark: SparkSession, rules: list[str]) -> DataFrame:
    return _parse(spark.createDataFrame([(r,) for r in rules], "value STRING"))
