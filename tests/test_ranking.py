import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lexidom.operators import ranking
from lexidom.operators.cleaning import cap_per_class


@pytest.fixture
def labelled(spark):
    rows = [(f"d{i}", int(i % 3 == 0), i) for i in range(1000)]
    return spark.createDataFrame(rows, "domain STRING, label INT, ord BIGINT").repartition(6)


def h(domain, seed=42):
    return hashlib.md5(f"{domain}|{seed}".encode()).hexdigest()


def test_split_is_exact_stratified_and_repeatable(labelled):
    split = ranking.stratified_split(labelled)
    assert split.columns == [*labelled.columns, "split"]
    sizes = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert sizes == {(1, "test"): 67, (1, "train"): 267, (0, "test"): 133, (0, "train"): 533}
    test = {r.domain for r in split.where("split = 'test'").collect()}
    again = {r.domain for r in ranking.stratified_split(labelled.repartition(2)).where("split = 'test'").collect()}
    assert test == again
    for label, n in ((0, 133), (1, 67)):
        names = sorted((f"d{i}" for i in range(1000) if int(i % 3 == 0) == label), key=h)
        assert set(names[:n]) <= test
    other = {r.domain for r in ranking.stratified_split(labelled, seed=7).where("split = 'test'").collect()}
    assert other != test


@pytest.mark.parametrize("size, n_test", [(0.0, 0), (1.0, 3), (0.5, 2)])
def test_split_extremes(spark, size, n_test):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "domain STRING, label INT")
    assert ranking.stratified_split(df, size).where("split = 'test'").count() == n_test


@pytest.mark.parametrize("digits", [None, 2])
def test_folds_follow_the_rank(labelled, digits):
    ranked = {r.domain: r["rank"] for r in ranking.hash_rank(labelled, digits=digits).collect()}
    for label in (0, 1):
        names = sorted((f"d{i}" for i in range(1000) if int(i % 3 == 0) == label), key=h)
        assert [ranked[n] for n in names] == list(range(1, len(names) + 1))
    folds = ranking.stratified_folds(labelled, 5)
    sizes = folds.groupBy("label", "fold").count().collect()
    assert len(sizes) == 10
    assert {r["count"] for r in sizes if r.label == 1} <= {66, 67}


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (37, 37), (1000, 1000), (5000, 1000)])
def test_sample_has_the_exact_size(labelled, n, want):
    got = {r.domain for r in ranking.sample_rows(labelled, n).collect()}
    assert len(got) == want
    if n == 37:
        assert got == set(sorted((f"d{i}" for i in range(1000)), key=h)[:37])


def test_cap_keeps_the_first_of_each_class(spark):
    # Positions in several stretches, as scan ids of many partitions have.
    rows = [(int(i % 3 == 0), (i % 4) * 2**33 + i * 40_000) for i in range(400)]
    df = spark.createDataFrame(rows, "label INT, ord BIGINT")
    got = sorted((r.label, r.ord) for r in cap_per_class(df, 100).collect())
    want = [(c, o) for c in (0, 1) for o in sorted(o for label, o in rows if label == c)[:100]]
    assert got == sorted(want)
    assert cap_per_class(df, 1000).count() == 400


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_median_is_exact(spark, n):
    rng = random.Random(n)
    values = {k: [rng.lognormvariate(0, 5) for _ in range(n)] for k in (1, 2)}
    values[3] = [5.0] * n + [1e9]  # one hot value and an outlier
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(1, None)]
    df = spark.createDataFrame(rows, "k INT, v DOUBLE").repartition(4)
    got = {r.k: r.median for r in ranking.exact_median(df, ["k"], "v").collect()}
    assert got == {k: pytest.approx(statistics.median(vs), rel=1e-12) for k, vs in values.items()}
    whole = ranking.exact_median(df, [], "v").first().median
    assert whole == pytest.approx(statistics.median([v for _, v in rows if v is not None]), rel=1e-12)


def test_cutoff_counts_duplicates(spark):
    df = spark.createDataFrame([(0, 5)] * 70 + [(0, 6)] * 30, "label INT, v INT")
    at = lambda q: ranking.cutoffs(df, ["label"], [F.col("v") / 2], F.col("v"), F.lit(q)).first().cutoff
    assert [at(1), at(70), at(71), at(100)] == [5, 5, 6, 6]


@pytest.mark.parametrize("ranked_rows", [1, 7, 50, 100_000])
def test_median_with_outliers_and_hot_values(spark, ranked_rows):
    rng = random.Random(ranked_rows)
    groups = {
        "outlier": [rng.random() for _ in range(400)] + [1e300, -1e300],
        "hot": [0.5] * 900 + [rng.random() for _ in range(100)],
        "near": [0.25 + i * 1e-15 for i in range(301)],
        "two": [1.0, 2.0], "one": [3.0], "same": [7.0] * 50,
        "wide": [rng.choice([1e-300, 1.0, 1e9, 1e300]) * rng.random() for _ in range(333)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(5)
    got = {r.k: r.median for r in ranking.exact_median(df, ["k"], "v", ranked_rows=ranked_rows).collect()}
    assert got == {k: statistics.median(vs) for k, vs in groups.items()}
    whole = ranking.exact_median(df, [], "v", ranked_rows=ranked_rows).first().median
    assert whole == statistics.median([v for _, v in rows if v is not None])
    big = [2**60 + i for i in range(99)]
    longs = spark.createDataFrame([(x,) for x in big], "v BIGINT")
    assert ranking.exact_median(longs, [], "v", ranked_rows=ranked_rows).first().median == float(big[49])
