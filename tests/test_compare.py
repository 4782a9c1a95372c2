import random
from collections import Counter

import pytest

from lexidom.operators.compare import compare_bags

SCHEMA = "k STRING, a DOUBLE, b DOUBLE"


def _plain(left, right):
    """Cancel equal rows, pair the k-th left over of each key."""
    a, b = Counter(left), Counter(right)
    both = sum((a & b).values())
    out = Counter(n_left=len(left), n_right=len(right), n_equal=both)
    rest = [sorted((x - y).elements(), key=lambda r: tuple((v is not None, v) for v in r[1:])) for x, y in ((a, b), (b, a))]
    for k in {r[0] for r in left + right}:
        xs, ys = ([r[1:] for r in side if r[0] == k] for side in rest)
        for x, y in zip(xs, ys):
            off = [u != v and (u is None or v is None or abs(u - v) > 1e-10 + 1e-5 * abs(v)) for u, v in zip(x, y)]
            out += Counter(n_rows_diff=int(any(off)), n_close=int(not any(off)), diff_a=int(off[0]), diff_b=int(off[1]))
        out += Counter(n_extra_left=max(0, len(xs) - len(ys)), n_extra_right=max(0, len(ys) - len(xs)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bags_with_repeated_keys(spark, seed):
    rng = random.Random(seed)
    left = [(rng.choice(["hot", "hot", "hot", "x", "y", None]), float(rng.randrange(4)), rng.choice([0.5, 1.5, None])) for _ in range(150)]
    right = [(k, a + rng.choice([0, 0, 1e-9, 2.0]), b) for k, a, b in left if rng.random() < 0.9] + rng.choices(left, k=12)
    got = compare_bags(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "k", ["a", "b"]).first().asDict()
    assert got == {c: _plain(left, right)[c] for c in got}


def test_bags_without_rows(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("x", float("nan"), 1.0)], SCHEMA)
    assert set(compare_bags(empty, empty, "k", ["a", "b"]).first()) == {0}
    got = compare_bags(one, one, "k", ["a", "b"]).first()
    assert (got.n_left, got.n_equal, got.n_rows_diff, got.diff_a, got.diff_b) == (1, 0, 1, 1, 0)
