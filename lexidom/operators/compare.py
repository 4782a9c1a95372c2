"""Comparison of two results keyed by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import assign_ord_within


def differs(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Not within tolerance. NaN differs from everything, infinities and
    missing values only from anything but themselves."""
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    close = finite & (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
    same = a.eqNullSafe(b) & ~F.coalesce(F.isnan(a), F.lit(False))
    return ~(same | F.coalesce(close, F.lit(False)))


def compare(
    left: DataFrame, right: DataFrame, key: str, columns: list[str], rtol: float = 1e-5,
    atol: float = 1e-10,
) -> DataFrame:
    """One row: row counts of both sides, keys found on one side only, rows
    with any difference, and differing rows per column."""
    a = left.select(key, *[F.col(c).cast("double").alias(f"_a_{c}") for c in columns], F.lit(1).alias("_l"))
    b = right.select(key, *[F.col(c).cast("double").alias(f"_b_{c}") for c in columns], F.lit(1).alias("_r"))
    both = a.join(b, key, "full_outer")
    flags = {c: differs(F.col(f"_a_{c}"), F.col(f"_b_{c}"), rtol, atol) for c in columns}
    paired = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    any_diff = F.lit(False)
    for flag in flags.values():
        any_diff = any_diff | flag
    return both.agg(
        F.count("_l").alias("n_left"),
        F.count("_r").alias("n_right"),
        F.count_if(~paired).alias("n_unpaired"),
        F.count_if(paired & any_diff).alias("n_rows_diff"),
        *[F.count_if(paired & flag).alias(f"diff_{c}") for c, flag in flags.items()],
    )


def compare_bags(
    left: DataFrame, right: DataFrame, key: str, columns: list[str], rtol: float = 1e-5,
    atol: float = 1e-10,
) -> DataFrame:
    """The same for tables whose keys repeat: one row of counts.

    Equal rows cancel by count. What is left is numbered inside its key in order of
    ``columns``; the k-th of both sides are a pair, and rows without one count as extra.
    A key that most rows share is cancelled by counts and numbered across partitions.
    """
    names = [key, *columns]
    sides = [
        side.select(F.col(key), *[F.col(c).cast("double").alias(c) for c in columns], F.lit(i).alias("_side"))
        for i, side in ((1, left), (-1, right))
    ]
    counted = sides[0].unionByName(sides[1]).groupBy(*names).agg(
        F.count_if(F.col("_side") > 0).alias("_l"), F.count_if(F.col("_side") < 0).alias("_r")
    )
    nan = F.lit(False)
    for c in columns:
        nan = nan | F.coalesce(F.isnan(c), F.lit(False))  # NaN differs from itself
    equal = F.when(nan, 0).otherwise(F.least("_l", "_r"))
    counted = counted.withColumn("_equal", equal)
    totals = counted.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("_r"), F.lit(0)).alias("n_right"),
        F.coalesce(F.sum("_equal"), F.lit(0)).cast("bigint").alias("n_equal"),
    )

    def rest(count: str, name: str) -> DataFrame:
        left_over = F.col(count) - F.col("_equal")
        rows = counted.where(left_over > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), left_over)))
        placed = assign_ord_within(rows.select(*names, "_copy"), [key], [*columns, "_copy"], "_k")
        return placed.select(F.col(key).alias(f"{name}_key"), F.col("_k").alias(f"{name}_k"), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    pairs = rest("_l", "_a").join(
        rest("_r", "_b"), F.col("_a_key").eqNullSafe(F.col("_b_key")) & (F.col("_a_k") == F.col("_b_k")), "full_outer"
    )
    paired = F.col("_a_k").isNotNull() & F.col("_b_k").isNotNull()
    flags = {c: differs(F.col(f"_a_{c}"), F.col(f"_b_{c}"), rtol, atol) for c in columns}
    any_diff = F.lit(False)
    for flag in flags.values():
        any_diff = any_diff | flag
    found = pairs.agg(
        F.count_if(paired & ~any_diff).alias("n_close"), F.count_if(paired & any_diff).alias("n_rows_diff"),
        F.count_if(F.col("_b_k").isNull()).alias("n_extra_left"), F.count_if(F.col("_a_k").isNull()).alias("n_extra_right"),
        *[F.count_if(paired & flag).alias(f"diff_{c}") for c, flag in flags.items()],
    )
    return totals.crossJoin(F.broadcast(found))  # one row each
