import random

import numpy as np
import pytest

from lexidom.llm.hard_negatives import SuffixIndex, mine, mine_embeddings
from pyspark.sql import functions as F

from . import brute

SCHEMA = "id BIGINT, label BIGINT, vector ARRAY<BIGINT>, rank INT"


def _rows(rng, n, width, top):
    centres = [[rng.randrange(-top, top + 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.randrange(6)
        v = [x + rng.randrange(-top // 2, top // 2 + 1) for x in centres[c]]
        rows.append((i, rng.choice([c % 3, c % 3, 7]), v))
    return rows


def _mined(spark, rows, every=5, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mine(df, F.col("id") % every == 0, **options).collect())


@pytest.mark.parametrize("width,top,shard_rows", [(20, 9, 64), (3, 2, 50), (1, 1, 999), (70, 300, 40)])
def test_mined_negatives_are_the_plain_ones(spark, width, top, shard_rows):
    rows = _rows(random.Random(width), 240, width, top)
    rows += [(i, lab, v) for i, lab, v in rows[:40]] + [rows[5]] * 30  # repeated rows
    assert _mined(spark, rows, shard_rows=shard_rows) == sorted(brute.hard_negatives(rows, 5))


def test_mining_of_odd_vectors(spark):
    huge = 2**40
    rows = [(i, i % 2, [huge + i, -huge, i]) for i in range(30)]
    rows += [(30 + i, i % 2, [i, 1, 2]) for i in range(30)]
    rows += [(60, 1, []), (65, 1, []), (61, 0, []), (70, 1, [1, 2]), (75, 3, [5, 5, 5])]
    want = [r for r in brute.hard_negatives(rows, 5)]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    small = [r for r in rows if len(r[2]) != 3 or abs(r[2][0]) < huge]
    assert _mined(spark, small) == sorted(brute.hard_negatives(small, 5))
    got = _mined(spark, rows, shard_rows=20)
    assert {(r[0], r[1], cut(r[4])) for r in want if abs(r[4]) < 2**62} <= {(r[0], r[1], r[4]) for r in got}
    assert mine(spark.createDataFrame([], SCHEMA), F.col("id") % 5 == 0).count() == 0


def test_mining_takes_usable_embeddings_only(spark):
    nan = float("nan")
    rows = [(i, i % 3, [float(i % 7), 1.0, -0.5]) for i in range(60)]
    odd = [(None, 1, [1.0] * 3), (100, None, [1.0] * 3), (150, 1, None), (200, 1, [1.0, None, 1.0]), (250, 1, [nan, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id BIGINT, label INT, embedding ARRAY<FLOAT>, score STRING")
    plain = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows]
    got = sorted(tuple(r) for r in mine_embeddings(df).collect())
    assert got == sorted(brute.hard_negatives(plain, 50)) and got


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_above_any_threshold(seed):
    rng = np.random.default_rng(seed)
    vectors = (rng.normal(size=(300, 40)) * rng.exponential(30, size=40)).astype(np.int64)
    index = SuffixIndex(np.arange(300), np.zeros(300, int), vectors)
    asked = vectors[:150]
    scores = asked @ vectors.T
    least = np.quantile(scores, rng.uniform(0.2, 1, 150), axis=1).diagonal().copy()
    least[:3] = -np.inf, 0, least.max() * 9
    for i, rows, found in index.above(asked, least):
        want = np.flatnonzero(scores[i] >= least[i])
        assert sorted(rows.tolist()) == want.tolist()
        assert dict(zip(rows.tolist(), found.tolist())) == {j: scores[i, j] for j in want}
