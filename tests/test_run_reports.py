import math
import statistics

import pytest
from pyspark.sql import functions as F

from lexidom.functions import stats
from lexidom.operators import run_reports


@pytest.mark.parametrize(
    "t, df, p",
    [
        # Two-sided critical values from printed t tables.
        (2.776445, 4, 0.05), (12.706205, 1, 0.05), (4.302653, 2, 0.05), (3.182446, 3, 0.05),
        (2.570582, 5, 0.05), (2.262157, 9, 0.05), (2.228139, 10, 0.05), (2.045230, 29, 0.05),
        (4.604095, 4, 0.01), (0.0, 4, 1.0), (-2.776445, 4, 0.05),
    ],
)
def test_two_sided_p(spark, t, df, p):
    row = spark.createDataFrame([(t, df)], "t DOUBLE, df BIGINT")
    got = row.select(stats.two_sided_p(F.col("t"), F.col("df"))).first()[0]
    assert got == pytest.approx(p, abs=2e-7)


def paired(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b)), "a DOUBLE, b DOUBLE")
    return run_reports.paired_t(df, "a", "b").first()


def test_paired_t(spark):
    a, b = [0.93, 0.91, 0.94, 0.92, 0.95], [0.90, 0.91, 0.91, 0.90, 0.92]
    d = [x - y for x, y in zip(a, b)]
    got = paired(spark, a, b)
    t = statistics.mean(d) / (statistics.stdev(d) / math.sqrt(5))
    assert got.t_statistic == pytest.approx(t)
    assert got.diff_std == pytest.approx(statistics.pstdev(d))
    assert got.std_a == pytest.approx(statistics.pstdev(a))
    assert got.significant_at_005 and got.p_value < 0.05


@pytest.mark.parametrize(
    "a, b, t, p, significant",
    [
        ([1.0, 2.0], [1.0, 2.0], None, None, False),
        ([2.0, 3.0], [1.0, 2.0], math.inf, 0.0, True),
        ([1.0, 2.0], [2.0, 3.0], -math.inf, 0.0, True),
        ([1.0], [2.0], None, None, False),
    ],
)
def test_paired_t_without_variation(spark, a, b, t, p, significant):
    got = paired(spark, a, b)
    assert (got.t_statistic, got.p_value, got.significant_at_005) == (t, p, significant)


E1 = [(1, 0, 76.0, 1.0, 25.0, 0.3), (1, 1, 74.0, 1.02, 23.0, 0.4), (8, 0, 12.0, 6.2, 56.0, 1.2), (8, 1, 13.0, 5.8, 57.0, 1.1)]


@pytest.fixture
def e1(spark):
    return spark.createDataFrame(
        E1, "k INT, rep INT, time_sec DOUBLE, speedup DOUBLE, cpu_util_avg DOUBLE, ipc_overhead_pct DOUBLE"
    )


def test_strong_scaling(e1):
    got = {r.k: r for r in run_reports.strong_scaling(e1).collect()}
    assert got[1].time_mean == 75.0 and got[1].time_std == pytest.approx(statistics.stdev([76, 74]))
    assert got[8].amdahl_predicted == pytest.approx(1 / (0.051 + 0.949 / 8))
    assert got[8].efficiency == pytest.approx(6.0 / 8)


def test_platform_comparison_and_keys(spark, e1):
    faster = e1.withColumn("speedup", F.col("speedup") * 1.5).where("k = 8")
    got = run_reports.platform_comparison(e1, faster).collect()
    assert [r.k for r in got] == [8] and got[0].advantage_pct == pytest.approx(50.0)
    assert [r.k for r in run_reports.ordered_keys(e1).collect()] == [1, 8]


def test_weak_scaling_and_chunk_sweep(spark):
    e8 = spark.createDataFrame(
        [(1, 125, 0, 10.0), (1, 125, 1, 12.0), (4, 500, 1, 20.0), (4, 499, 0, 24.0)],
        "k INT, n INT, rep INT, time_sec DOUBLE",
    )
    got = {r.k: r for r in run_reports.weak_scaling(e8).collect()}
    assert got[1].weak_efficiency == 1.0 and got[4].weak_efficiency == 0.5 and got[4].n == 499
    e4 = e8.selectExpr("k AS k_split", "n AS chunk_size", "rep", "time_sec", "100 / time_sec AS throughput")
    assert {r.k_split: r.chunk_size for r in run_reports.chunk_sweep(e4).collect()} == {1: 125, 4: 499}


def test_sample_statistics(spark):
    df = spark.createDataFrame([("a", [[1.0, 2.0], [6.0]]), ("b", [[]]), ("c", [])], "g STRING, s ARRAY<ARRAY<DOUBLE>>")
    got = {r.g: (r.avg_utilization, r.max_utilization, r.min_utilization)
           for r in run_reports.sample_statistics(df, "s", ["g"]).collect()}
    assert got == {"a": (3.0, 6.0, 1.0), "b": (0.0, 0.0, 0.0), "c": (0.0, 0.0, 0.0)}


def test_share_and_zero_total(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 9.0)], "f STRING, t DOUBLE")
    assert {r.f: r.pct for r in run_reports.share_of_total(df, "f", "t").collect()} == {"x": 25.0, "y": 75.0}
    nothing = df.withColumn("t", F.lit(0.0))
    assert {r.pct for r in run_reports.share_of_total(nothing, "f", "t").collect()} == {0.0}


@pytest.mark.parametrize(
    "metric, value, status",
    [("speedup_k8", 5.5, "target"), ("speedup_k8", 4.0, "minimum"), ("speedup_k8", 3.9, "missed"),
     ("accuracy", 0.93, "minimum"), ("accuracy", 0.9318, "target"), ("accuracy", 0.90, "missed"),
     ("ipc_overhead_pct", 1.23, "target"), ("ipc_overhead_pct", 5.0, "minimum"),
     ("ipc_overhead_pct", 10.0, "missed"), ("throughput_k8", 60512.0, "target"),
     ("cpu_utilization_pct", 56.3, "missed")],
)
def test_acceptance(spark, metric, value, status):
    df = spark.createDataFrame([(metric, value)], "metric STRING, value DOUBLE")
    rows = {r.metric: r.status for r in run_reports.acceptance(df).collect()}
    assert rows[metric] == status and len(rows) == 5


def test_zero_safe_ratios(spark):
    df = spark.createDataFrame([(4.0, 0.0), (4.0, 2.0)], "a DOUBLE, b DOUBLE")
    for fn in (stats.speedup, stats.efficiency, stats.throughput, stats.zero_safe):
        assert [r[0] for r in df.select(fn(F.col("a"), F.col("b"))).collect()] == [0.0, 2.0]
    assert [r[0] for r in df.select(stats.overhead_pct(F.col("a"), F.col("b"))).collect()] == [0.0, 200.0]
