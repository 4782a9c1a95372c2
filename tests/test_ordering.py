import random

import pytest
from pyspark.sql import functions as F

from lexidom.operators.ordering import assign_chunk, assign_ord, assign_ord_within, prefix_rows, with_previous

from . import brute

HOSTS = sorted("mill mills millet milk pond ponder yonder wonder q zzz zz z7 a ab ba baab rill".split())
DISTANCES = [int(brute.edit_distance(a, b)) for a, b in zip(HOSTS, HOSTS[:1] + HOSTS)]


@pytest.mark.parametrize("chunk_rows", [1, 2, 4, 5, 8, 20, 40])
def test_distances_at_chunk_boundaries(domain_rows, chunk_rows):
    rows = with_previous(domain_rows(HOSTS), chunk_rows=chunk_rows)
    got = rows.orderBy("ord").select(F.levenshtein("domain", "prev").alias("d")).collect()
    assert [r.d for r in got] == DISTANCES


@pytest.mark.parametrize("partitions", [1, 2, 4, 5, 8, 40])
def test_previous_for_any_partitioning(domain_rows, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    names = [f"d{i:04d}" for i in range(100)]
    rows = with_previous(domain_rows(names).repartition(partitions), chunk_rows=9).orderBy("ord").collect()
    assert [r.domain for r in rows] == names
    assert [r.prev for r in rows] == names[:1] + names[:-1]


def test_previous_of_one_row_and_none(domain_rows):
    assert with_previous(domain_rows(["x"])).first().prev == "x"
    assert with_previous(domain_rows([])).count() == 0


def test_exact_multiple_of_chunk_loses_and_adds_nothing(domain_rows):
    rows = with_previous(domain_rows([str(i) for i in range(12)]), chunk_rows=4)
    assert rows.count() == 12


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_assign_ord_is_dense_and_sorted(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    names = [f"{random.Random(i).random()}" for i in range(500)] + ["é", "z", "Z", ""]
    df = spark.createDataFrame([(n,) for n in names], "domain STRING").repartition(7)
    got = [(r.ord, r.domain) for r in assign_ord(df, ["domain"]).orderBy("ord").collect()]
    assert got == list(enumerate(sorted(names)))


def test_assign_ord_with_a_hot_value_and_tiebreak(spark):
    rows = [("hot", i) for i in range(300)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "domain STRING, seq INT").repartition(5)
    got = assign_ord(df, ["domain", "seq"]).orderBy("ord").collect()
    assert [(r.domain, r.seq) for r in got] == sorted(rows)
    assert [r.ord for r in got] == list(range(305))


@pytest.mark.parametrize("n, k", [(100, 4), (20, 3), (10, 10), (7, 10), (1, 4), (23, 5)])
def test_chunks_are_balanced_and_contiguous(domain_rows, n, k):
    rows = assign_chunk(domain_rows([str(i) for i in range(n)]), k).orderBy("ord").collect()
    got = [r.chunk for r in rows]
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    assert got == [i for i, size in enumerate(sizes) for _ in range(size)]


def test_prefix(domain_rows):
    assert prefix_rows(domain_rows(HOSTS), 3).count() == 3


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_each_segment_is_numbered_alone(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    rng = random.Random(partitions)
    rows = [(rng.choice(["train", "train", "train", "test", None]), f"d{i:03d}") for i in range(200)] + [("one", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "split STRING, domain STRING").repartition(5)
    numbered = assign_ord_within(df, ["split"], ["domain"])
    got = {(r.split, r.domain): r.prev for r in with_previous(numbered, by=["split"], chunk_rows=7).collect()}
    ords = {(r.split, r.domain): r.ord for r in numbered.collect()}
    for split in {s for s, _ in rows}:
        names = sorted(d for s, d in rows if s == split)
        assert [ords[split, d] for d in names] == list(range(len(names)))
        assert [got[split, d] for d in names] == names[:1] + names[:-1]
    assert len(got) == len(rows)


def test_segments_of_no_rows(spark):
    empty = spark.createDataFrame([], "split STRING, domain STRING")
    assert with_previous(assign_ord_within(empty, ["split"], ["domain"]), by=["split"]).count() == 0
