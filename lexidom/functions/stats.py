"""Numeric expressions of the run-metric reports and the paired test."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: parallel fraction behind the predicted-speedup column.
PARALLEL_FRACTION = 0.949


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def zero_safe(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is 0 or missing."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))


def ieee_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as in floating point: infinite or NaN where the denominator
    is 0, of the other sign where it is -0.0."""
    infinite = F.when(denominator.cast("string").startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(denominator == 0, numerator * infinite).otherwise(
        numerator / F.nullif(denominator, F.lit(0))
    )


def speedup(baseline: Column, time: Column, ratio=ratio_or_zero) -> Column:
    return ratio(baseline, time)


def efficiency(speedup_: Column, k: Column) -> Column:
    return ratio_or_zero(speedup_, k)


def throughput(n: Column, time: Column, ratio=ratio_or_zero) -> Column:
    return ratio(n, time)


def overhead_pct(part: Column, total: Column) -> Column:
    return ratio_or_zero(part * 100, total)


def amdahl(k: Column, parallel: float = PARALLEL_FRACTION) -> Column:
    return F.lit(1.0) / (F.lit(1.0 - parallel) + F.lit(parallel) / k)


def two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom.

    Finite trigonometric series (Abramowitz & Stegun 26.7.3 and 26.7.4) with
    theta = atan(|t| / sqrt(df)); the series runs over powers of cos(theta).
    """
    theta = F.atan(F.abs(t) / F.sqrt(df))
    s, c = F.sin(theta), F.cos(theta)
    odd = df % 2 == 1
    # Terms j = 0 .. floor(df/2)-1 (even) or floor((df-1)/2)-1 (odd).
    terms = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")

    def step(acc: Column, j: Column) -> Column:
        grow = F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        term = F.when(j == 0, F.lit(1.0)).otherwise(acc["term"] * grow * c * c)
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("term"))
    steps = F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(
        F.array().cast("array<int>")
    )
    series = F.aggregate(steps, zero, step)["total"]
    inside = F.when(odd, (theta + s * c * series) * (2.0 / 3.141592653589793)).otherwise(s * series)
    return F.greatest(F.lit(0.0), F.lit(1.0) - inside)
