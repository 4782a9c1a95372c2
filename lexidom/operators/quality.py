"""Feature validation: rule columns, per-chunk reports, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import FEATURES_6
from ..session import stage

# Fixed value: slack of the range rules.
TOLERANCE = 1e-9

# Rules in the order they are checked.
RULES = [
    "nan", "inf", "length", "numerical_ratio", "meaningful_word_ratio", "pronounceability",
    "lms_percentage", "levenshtein",
]


def broken_rules(columns: list[str]) -> dict[str, Column]:
    """One boolean per rule, true where a row breaks it.

    NaN compares above every number in Spark, so the range rules speak only of
    rows that hold numbers; missing values count as NaN.
    """
    names = [c for c in FEATURES_6 if c in columns]
    v = {c: F.col(c) for c in names}
    nan = _any([F.isnull(x) | F.isnan(x) for x in v.values()])
    inf = _any([F.coalesce(F.abs(x) == float("inf"), F.lit(False)) for x in v.values()])
    in_unit = lambda x: (x < -TOLERANCE) | ((x > 1 + TOLERANCE) & ~F.isnan(x))
    below = lambda x, least: x < least
    ranges = {
        "length": lambda x: below(x, 0),
        "numerical_ratio": in_unit,
        "meaningful_word_ratio": in_unit,
        "pronounceability": lambda x: below(x, -TOLERANCE),
        "lms_percentage": in_unit,
        "levenshtein": lambda x: below(x, -TOLERANCE),
    }
    rules = {"nan": nan, "inf": inf}
    for name in names:
        rules[name] = F.coalesce(ranges[name](v[name]), F.lit(False))
    return rules


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def first_broken(counts: dict[str, Column]) -> Column:
    """Name of the first rule with a positive count, in checking order."""
    return F.coalesce(*[F.when(c > 0, F.lit(name)) for name, c in counts.items()])


def validation_report(
    features: DataFrame, chunk: str = "chunk", expected: DataFrame | None = None,
    width: int = 6,
) -> DataFrame:
    """Per chunk: rows, one count per rule, valid, and the first reason.

    ``expected`` (chunk, expected_rows) adds the row-count rule, also for
    chunks that produced nothing; chunks it doesn't name, the null chunk too,
    fail it. A table without ``width`` feature columns
    fails as a whole, as the wrong shape. Counts fold on the map side, so a
    chunk may be any size.
    """
    rules = broken_rules(features.columns)
    names = [c for c in FEATURES_6 if c in features.columns]
    counts = features.groupBy(chunk).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(flag).alias(f"bad_{name}") for name, flag in rules.items()],
    )
    if expected is not None:
        asked = expected.withColumnRenamed(chunk, "_asked")
        both = asked.join(counts, F.col("_asked").eqNullSafe(F.col(chunk)), "full_outer")
        found = [F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != chunk]
        counts = both.select(F.coalesce(chunk, "_asked").alias(chunk), "expected_rows", *found)
    wanted = F.coalesce("expected_rows", F.lit(-1)) if expected is not None else F.col("n_rows")
    shape = ((F.col("n_rows") != wanted) | F.lit(len(names) != width)).cast("long")
    checks = {"shape": shape, **{name: F.col(f"bad_{name}") for name in rules}}
    reported = counts.withColumn("reason", first_broken(checks))
    return reported.withColumn("valid", F.col("reason").isNull())


def split_quarantine(
    features: DataFrame, report: DataFrame, chunk: str = "chunk"
) -> tuple[DataFrame, DataFrame]:
    """(rows of valid chunks, rows of failing chunks with their reason).

    Each row is in one of the two, those of the null chunk as well. The verdicts
    are staged: both sides read them, and their size decides how they are joined.
    """
    verdict = stage(report.select(chunk, "valid", "reason"), "verdicts")
    same = features[chunk].eqNullSafe(F.col("_judged"))
    joined = features.join(verdict.withColumnRenamed(chunk, "_judged"), same).drop("_judged")
    valid = joined.where("valid").drop("valid", "reason")
    return valid, joined.where("not valid").drop("valid")


def require_valid(report: DataFrame, chunk: str = "chunk") -> None:
    """Raise if any chunk fails, naming how many and the first few."""
    failed = report.where("not valid")
    n = failed.count()
    if n:
        some = [f"{r[chunk]} ({r.reason})" for r in failed.orderBy(chunk).limit(10).collect()]
        raise RuntimeError(f"{n} chunk(s) failed validation, first: {', '.join(some)}")
