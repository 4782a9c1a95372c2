"""Reports over run-metric tables: scaling summaries, comparisons, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import amdahl, efficiency, two_sided_p


def strong_scaling(runs: DataFrame) -> DataFrame:
    """Per k: mean and sample deviation of time and speedup, mean CPU and
    overhead, with the predicted speedup and the efficiency."""
    return (
        runs.groupBy("k")
        .agg(
            F.avg("time_sec").alias("time_mean"),
            F.stddev_samp("time_sec").alias("time_std"),
            F.avg("speedup").alias("speedup_mean"),
            F.stddev_samp("speedup").alias("speedup_std"),
            F.avg("cpu_util_avg").alias("cpu_util"),
            F.avg("ipc_overhead_pct").alias("ipc_overhead"),
        )
        .withColumn("amdahl_predicted", amdahl(F.col("k")))
        .withColumn("efficiency", F.col("speedup_mean") / F.col("k"))
    )


def efficiency_summary(runs: DataFrame) -> DataFrame:
    return (
        runs.groupBy("k")
        .agg(
            F.avg("time_sec").alias("time_mean"),
            F.avg("speedup").alias("speedup_mean"),
            F.avg("efficiency").alias("efficiency_mean"),
            F.avg("ipc_overhead_pct").alias("ipc_overhead"),
            F.avg("mem_delta_mb").alias("mem_delta"),
        )
        .withColumn("amdahl_efficiency", efficiency(amdahl(F.col("k")), F.col("k")))
    )


def dataset_scaling(runs: DataFrame) -> DataFrame:
    return runs.groupBy("n").agg(
        F.avg("time_sec").alias("time_mean"),
        F.stddev_samp("time_sec").alias("time_std"),
        F.avg("throughput").alias("throughput_mean"),
        F.stddev_samp("throughput").alias("throughput_std"),
    )


def chunk_sweep(runs: DataFrame) -> DataFrame:
    """Per split count; the chunk size is that of the lowest repetition."""
    return runs.groupBy("k_split").agg(
        F.min_by("chunk_size", "rep").alias("chunk_size"),
        F.avg("time_sec").alias("time_mean"),
        F.stddev_samp("time_sec").alias("time_std"),
        F.avg("throughput").alias("throughput_mean"),
    )


def weak_scaling(runs: DataFrame, baseline_k: int = 1) -> DataFrame:
    """Per k: size, time, and the baseline's mean time over this one's."""
    summary = runs.groupBy("k").agg(
        F.min_by("n", "rep").alias("n"),
        F.avg("time_sec").alias("time_mean"),
        F.stddev_samp("time_sec").alias("time_std"),
    )
    baseline = runs.where(F.col("k") == baseline_k).agg(F.avg("time_sec").alias("_t1"))  # one row
    return summary.crossJoin(F.broadcast(baseline)).select(
        "k", "n", "time_mean", "time_std", (F.col("_t1") / F.col("time_mean")).alias("weak_efficiency")
    )


def platform_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean time, speedup, overhead and CPU by k on two platforms, and the
    right one's speedup advantage in percent."""

    def means(runs: DataFrame, tag: str) -> DataFrame:
        return runs.groupBy("k").agg(
            F.avg("time_sec").alias(f"{tag}_time"),
            F.avg("speedup").alias(f"{tag}_speedup"),
            F.avg("ipc_overhead_pct").alias(f"{tag}_ipc"),
            F.avg("cpu_util_avg").alias(f"{tag}_cpu"),
        )

    ls, rs = F.col("left_speedup"), F.col("right_speedup")
    return means(left, "left").join(means(right, "right"), "k").withColumn(
        "advantage_pct", (rs - ls) / F.nullif(ls, F.lit(0.0)) * 100
    )


def ordered_keys(runs: DataFrame, key: str = "k") -> DataFrame:
    return runs.select(key).distinct().orderBy(key)


def sample_statistics(samples: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean, max and min over every number in an array-of-arrays column;
    0 for groups whose samples are all empty."""
    values = samples.select(*by, F.explode_outer(F.flatten(column)).alias("v"))
    zero = F.lit(0.0)
    return values.groupBy(*by).agg(
        F.coalesce(F.avg("v"), zero).alias("avg_utilization"),
        F.coalesce(F.max("v").cast("double"), zero).alias("max_utilization"),
        F.coalesce(F.min("v").cast("double"), zero).alias("min_utilization"),
    )


def share_of_total(parts: DataFrame, name: str, value: str) -> DataFrame:
    """Each part's sum, and its percentage of the sum of all parts."""
    sums = parts.groupBy(name).agg(F.sum(value).alias("total"))
    whole = parts.agg(F.sum(value).alias("_whole"))  # one row
    pct = F.when(F.col("_whole") != 0, F.col("total") / F.col("_whole") * 100).otherwise(0.0)
    return sums.crossJoin(F.broadcast(whole)).select(name, "total", pct.alias("pct"))


# Metric, target, minimum, and whether more is better.
ACCEPTANCE = [
    ("speedup_k8", 5.5, 4.0, True, False),
    ("cpu_utilization_pct", 85.0, 70.0, True, True),
    ("ipc_overhead_pct", 5.0, 10.0, False, True),
    ("accuracy", 0.93, 0.90, True, True),
    ("throughput_k8", 50000.0, 30000.0, True, True),
]


def acceptance(measured: DataFrame) -> DataFrame:
    """Status of (metric, value) rows: target, minimum or missed.

    Strict bounds must be passed, the others may be met exactly. Metrics
    nobody measured count as 0.
    """
    spark = measured.sparkSession
    bounds = spark.createDataFrame(
        ACCEPTANCE, "metric STRING, target DOUBLE, minimum DOUBLE, more BOOLEAN, strict BOOLEAN"
    )
    value = F.coalesce(F.col("value"), F.lit(0.0))
    meets = lambda bound: (
        F.when(F.col("more") & F.col("strict"), value > bound)
        .when(F.col("more"), value >= bound)
        .when(F.col("strict"), value < bound)
        .otherwise(value <= bound)
    )
    status = F.when(meets(F.col("target")), "target").when(meets(F.col("minimum")), "minimum")
    return bounds.join(measured, "metric", "left").select(
        "metric", "target", "minimum", value.alias("value"), status.otherwise("missed").alias("status")
    )


def score_summary(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    )


def paired_t(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Paired two-sided t-test of columns a and b over rows (folds).

    All differences equal: t and p are undefined when they are 0, else the
    difference is certain (p = 0).
    """
    d = F.col(a) - F.col(b)
    sums = pairs.groupBy(*(by or [])).agg(
        F.count(d).alias("n"),
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.stddev_pop(a).alias("std_a"), F.stddev_pop(b).alias("std_b"),
        F.avg(d).alias("diff_mean"), F.stddev_pop(d).alias("diff_std"),
        F.stddev_samp(d).alias("_s"), F.min(d).alias("_min"), F.max(d).alias("_max"),
    )
    constant = (F.col("_min") == F.col("_max")) | (F.col("_s") == 0)
    error = F.nullif(F.col("_s"), F.lit(0.0)) / F.sqrt("n")
    t = F.when(~constant, F.col("diff_mean") / error).when(
        F.col("_min") != 0, F.signum("_min") * float("inf")
    )
    usable = (F.col("n") > 1) & F.col("t_statistic").isNotNull()
    p: Column = F.when(usable & (F.abs("t_statistic") == float("inf")), F.lit(0.0)).when(
        usable, two_sided_p(F.col("t_statistic"), F.col("n") - 1)
    )
    return (
        sums.withColumn("t_statistic", F.when(F.col("n") > 1, t))
        .withColumn("p_value", p)
        .withColumn("significant_at_005", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
        .drop("_s", "_min", "_max")
    )
