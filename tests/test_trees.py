import random
from fractions import Fraction

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from lexidom.ml import trees


def _plain_tree(rows, max_depth, node="r", depth=0):
    """node -> (n, n1, feature, threshold) of (x, y) rows, by trying every cut."""
    n, n1 = len(rows), sum(y for _, y in rows)
    out = {node: (n, n1, None, None)}
    if depth == max_depth or n1 in (0, n):
        return out
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for v, w in zip(values, values[1:]):
            score = 0
            for side in ([y for x, y in rows if x[f] <= v], [y for x, y in rows if x[f] > v]):
                score += Fraction((len(side) - sum(side)) ** 2 + sum(side) ** 2, len(side))
            if best is None or score > best[0]:
                best = (score, f, v + (w - v) / 2)
    if best is None:
        return out
    _, f, cut = best
    out[node] = (n, n1, f, cut)
    for k, keep in (("0", True), ("1", False)):
        out |= _plain_tree([r for r in rows if (r[0][f] <= cut) == keep], max_depth, node + k, depth + 1)
    return out


def _rows(rng, n, values):
    rows = []
    for i in range(n):
        x = [rng.choice(values) for _ in range(3)]
        rows.append((f"k{i}", *x, int(x[0] + x[1] * rng.random() > x[2] * 1.5)))
    return rows


SCHEMA = "domain STRING, a DOUBLE, b DOUBLE, c DOUBLE, label INT"


@pytest.mark.parametrize("values,max_depth", [([0.0, 1.0, 2.0], 4), ([i / 7 for i in range(40)], 3), ([1.0], 3), ([0.0, 1e300, -5.0], 2)])
def test_a_tree_is_the_plain_one(spark, shuffle_partitions, values, max_depth):
    shuffle_partitions(5)
    rows = _rows(random.Random(len(values)), 120, values)
    nodes = trees.grow(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], max_depth=max_depth)
    got = {r.node: (r.n, r.n1, None if r.feature is None else "abc".index(r.feature), r.threshold) for r in nodes.collect()}
    assert got == _plain_tree([(r[1:4], r[4]) for r in rows], max_depth)


def test_an_unlimited_tree_fits_its_rows(spark):
    rows = [(f"k{i}", float(i), float(i % 3), 0.5, random.Random(i).randrange(2)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = trees.grow(df, ["a", "b", "c"])
    assert all(r.n1 in (0, r.n) for r in nodes.where("feature IS NULL").collect())
    for limit in (10_000, 3):
        scored = trees.predict(df, nodes, limit).collect()
        assert len(scored) == 40 and all(r.prediction == r.label for r in scored)


def test_forests_repeat_and_both_predictions_agree(spark):
    df = spark.createDataFrame(_rows(random.Random(5), 200, [i / 9 for i in range(30)]), SCHEMA)
    grown = [trees.grow(df.repartition(k), ["a", "b", "c"], trees=4, bootstrap=True, n_features=2, max_depth=3) for k in (1, 7)]
    first, second = (sorted(map(tuple, g.select(*trees.NODE_COLUMNS).collect()), key=repr) for g in grown)
    assert first == second and len({r[0] for r in first}) == 4
    roots = {r[3] for r in first if r[1] == "r"}
    assert len(roots) > 1 and all(150 < n < 250 for n in roots)  # drawn weights
    small, joined = (trees.predict(df, grown[0], n).select("domain", "p_dga", "votes", "prediction") for n in (10_000, 2))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, joined.collect()))


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trees.grow(empty, ["a"]).count() == 0
    one = trees.grow(spark.createDataFrame([("x", 1.0, 1.0, 1.0, 1)], SCHEMA), ["a", "b"]).collect()
    assert [(r.node, r.n, r.feature, r.prediction) for r in one] == [("r", 1, None, 1)]
    with pytest.raises(Exception, match="is null"):
        trees.grow(spark.createDataFrame([("x", None, 1.0, 1.0, 1)], SCHEMA), ["a"])


@pytest.mark.parametrize("forest", [False, True])
def test_saved_models_predict_as_node_tables(spark, tmp_path, forest):
    df = spark.createDataFrame(_rows(random.Random(8), 300, [i / 11 for i in range(50)]), SCHEMA)
    wide = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    kind = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1) if forest else DecisionTreeClassifier(maxDepth=4)
    model = kind.fit(wide)
    model.save(str(tmp_path / "m"))
    want = {r.domain: r.p for r in model.transform(wide).select("domain", vector_to_array("probability")[1].alias("p")).collect()}
    nodes = trees.saved_nodes(spark, str(tmp_path / "m"), ["a", "b", "c"])
    for limit in (10_000, 1):
        got = {r.domain: r.p_dga for r in trees.predict(df, nodes, limit).collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)
