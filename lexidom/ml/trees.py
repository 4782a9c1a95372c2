"""Exact decision trees as tables of nodes.

Trees are grown level by level. Per level the rows are counted by (tree, node,
feature, value); running sums over the sorted values give both sides of every cut,
and the best cut by Gini impurity is chosen by whole-number arithmetic, ties by
feature, then value. No values are binned and depth has no limit of its own. All trees
of a forest grow in the same passes; each takes whole-number row weights and a
choice of features from seeded hashes, so a fit repeats on any cluster.

A node table has a row per node: tree, node, depth, n (weight), n1 (weight of class
1), feature (null for a leaf), threshold, left, right, prediction, p1. Rows whose
feature is at most the threshold go left. Nodes are named by their path: r, r0, r1,
r00 and so on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import decode_label
from ..session import fits_broadcast, stage

#: Cumulative Poisson(1) probabilities times 2^32: weights 0, 1, 2 ... of a bootstrap draw.
POISSON = [1580030169, 3160060337, 3950075422, 4213413783, 4279248373, 4292415292, 4294609778, 4294923276, 4294962463]
#: A tree of no more nodes is predicted by one expression, larger ones by joins.
EXPRESSION_NODES = 512

NODE_COLUMNS = "tree node depth n n1 feature threshold left right prediction p1".split()


def drawn(*parts: Column | str, seed: int) -> Column:
    """32 bits of a seeded hash."""
    name = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint")


def bootstrap_weight(key: Column, tree: Column, seed: int) -> Column:
    """How often a tree draws a row: Poisson with mean one, by hash."""
    u = drawn(key.cast("string"), tree.cast("string"), seed=seed)
    return sum((F.when(u >= limit, 1).otherwise(0) for limit in POISSON), F.lit(0)).cast("bigint")


def _running(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Add to value counts, per key in order of value: weight and weight of class 1 so far, and of all.

    A key may hold most values (at the root, each feature holds all), so the counts are
    range-sorted, summed inside the partitions, and completed by the sums of the
    partitions before.
    """
    order = [*keys, "value"]
    placed = stage(
        counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "counts"
    )
    sums = placed.groupBy(*keys, "_p").agg(F.sum("n").alias("_n"), F.sum("n1").alias("_n1"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = sums.select(  # at most one row per key and partition
        *keys, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n1").over(before), F.lit(0)).alias("_before1"),
        F.sum("_n").over(whole).alias("all"), F.sum("_n1").over(whole).alias("all1"),
    )
    inside = Window.partitionBy(*keys, "_p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_upto", F.sum("n").over(inside)).withColumn("_upto1", F.sum("n1").over(inside))
        .join(starts, [*keys, "_p"])
        .select(
            *keys, "value", (F.col("_before") + F.col("_upto")).alias("upto"),
            (F.col("_before1") + F.col("_upto1")).alias("upto1"), "all", "all1",
        )
    )


def purity() -> tuple[Column, Column]:
    """Rank of a cut: quotient and rest of the fraction that the least impurity makes greatest.

    With l, r the weights of the sides and their classes' squares, impurity falls as
    (l0^2 + l1^2) / l + (r0^2 + r1^2) / r grows. The whole part is exact; the rest is one
    division, which equal fractions round alike.
    """
    big = lambda c: c.cast("decimal(20,0)")
    left, left1 = F.col("upto"), F.col("upto1")
    right, right1 = F.col("all") - left, F.col("all1") - left1
    square = lambda n, n1: big((n - n1) * (n - n1) + n1 * n1)
    top = square(left, left1) * big(right) + square(right, right1) * big(left)
    under = big(left) * big(right)
    rest = top % under
    whole = ((top - rest) / under).cast("decimal(38,0)")
    return whole, rest.cast("double") / under.cast("double")


def best_cuts(counts: DataFrame) -> DataFrame:
    """tree, node, feature, value: the best cut of each node that has any."""
    sums = _running(counts, ["tree", "node", "feature"]).where("upto < `all`")
    whole, rest = purity()
    rank = F.struct(whole.alias("a"), rest.alias("b"), (-F.col("feature")).alias("c"), (-F.col("value")).alias("d"))
    best = sums.groupBy("tree", "node").agg(F.max(rank).alias("best"))
    return best.select("tree", "node", (-F.col("best.c")).alias("feature"), (-F.col("best.d")).alias("value"))


def grow(
    rows: DataFrame, features: list[str], label: str = "label", key: str = "domain", trees: int = 1,
    bootstrap: bool = False, n_features: int | None = None, max_depth: int | None = None, seed: int = 42,
) -> DataFrame:
    """The node table of ``trees`` trees over ``rows`` (label 0 or 1, ``key`` unique).

    ``bootstrap`` draws row weights per tree, ``n_features`` limits the features that a
    node may cut by hash. Nodes of one class, and those no feature cuts, are leaves.
    Rows with a null label or feature are refused.
    """
    names = list(features)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [label, *names]])
    values = F.when(missing, F.raise_error(F.lit("a label or feature is null"))).otherwise(
        F.array(*[F.col(c).cast("double") for c in names])
    )
    tree = F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree")
    at = rows.select(F.col(key).alias("key"), F.col(label).cast("bigint").alias("y"), values.alias("x"), tree)
    weight = bootstrap_weight(F.col("key"), F.col("tree"), seed) if bootstrap else F.lit(1).cast("bigint")
    at = at.select("tree", "y", "x", weight.alias("w"), F.lit("r").alias("node")).where("w > 0")
    at, levels, depth = stage(at, "rows"), [], 0
    while True:
        sums = stage(
            at.groupBy("tree", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("n1")), "nodes"
        )
        cuts = None
        if max_depth is None or depth < max_depth:
            open_ = at.join(sums.where("n1 > 0 AND n1 < n").select("tree", "node"), ["tree", "node"])
            long = open_.select("tree", "node", "y", "w", F.posexplode("x").alias("feature", "value"))
            if n_features and n_features < len(names):
                long = long.join(_allowed(sums, len(names), n_features, seed), ["tree", "node", "feature"])
            counts = stage(
                long.groupBy("tree", "node", "feature", "value")
                .agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("n1")),
                "values",
            )
            cuts = stage(_with_threshold(best_cuts(counts), counts), "cuts")
            if cuts.isEmpty():
                cuts = None
        levels.append(_node_rows(sums, cuts, names, depth))
        if cuts is None:
            return stage(reduce(DataFrame.unionByName, levels), "tree")
        side = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), "0").otherwise("1")
        at = stage(
            at.join(cuts, ["tree", "node"]).select("tree", "y", "x", "w", F.concat("node", side).alias("node")), "rows"
        )
        depth += 1


def _allowed(sums: DataFrame, n: int, n_features: int, seed: int) -> DataFrame:
    """tree, node, feature: the ``n_features`` features of least hash of each node."""
    each = sums.select("tree", "node", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("feature"))
    h = drawn(F.col("tree").cast("string"), "node", F.col("feature").cast("string"), seed=seed)
    order = Window.partitionBy("tree", "node").orderBy(h, "feature")  # n rows
    return each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n_features).drop("_r")


def _with_threshold(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """Cuts halfway between the value and the next one that occurs."""
    above = counts.join(cuts.withColumnRenamed("value", "at"), ["tree", "node", "feature"]).where("value > at")
    next_ = above.groupBy("tree", "node", "feature", "at").agg(F.min("value").alias("next"))
    middle = F.col("at") + (F.col("next") - F.col("at")) / 2
    # between neighbouring doubles the middle may round up to the next value
    return next_.select("tree", "node", "feature", F.when(middle < F.col("next"), middle).otherwise(F.col("at")).alias("threshold"))


def _node_rows(sums: DataFrame, cuts: DataFrame | None, names: list[str], depth: int) -> DataFrame:
    if cuts is None:
        cuts = sums.sparkSession.createDataFrame([], "tree INT, node STRING, feature INT, threshold DOUBLE")
    name = F.get(F.array(*[F.lit(c) for c in names]), F.col("feature"))
    inner = F.col("feature").isNotNull()
    return sums.join(cuts, ["tree", "node"], "left").select(
        "tree", "node", F.lit(depth).alias("depth"), "n", "n1", name.alias("feature"), "threshold",
        F.when(inner, F.concat("node", F.lit("0"))).alias("left"), F.when(inner, F.concat("node", F.lit("1"))).alias("right"),
        (2 * F.col("n1") > F.col("n")).cast("int").alias("prediction"), (F.col("n1") / F.col("n")).alias("p1"),
    )


# ------------------------------------------------------------------ prediction


def _expression(nodes: dict, node: str) -> Column:
    """The leaf's probability as nested cases."""
    row = nodes[node]
    if row.feature is None:
        return F.lit(row.p1)
    return F.when(F.col(row.feature) <= row.threshold, _expression(nodes, row.left)).otherwise(_expression(nodes, row.right))


def _by_expression(df: DataFrame, nodes: list, out: str) -> DataFrame:
    trees: dict[int, dict] = {}
    for row in nodes:
        trees.setdefault(row.tree, {})[row.node] = row
    leaves = [_expression(t, next(n for n, r in t.items() if r.depth == 0)) for _, t in sorted(trees.items())]
    return df.withColumn(out, F.array(*leaves))


def _by_joins(df: DataFrame, nodes: DataFrame, out: str) -> DataFrame:
    """Rows walk down by one join a level, from each tree's root."""
    features = [r.feature for r in nodes.where("feature IS NOT NULL").select("feature").distinct().collect()]
    named = F.create_map(*[x for c in features for x in (F.lit(c), F.col(c).cast("double"))]) if features else F.lit(None).cast("map<string,double>")
    table = nodes.select("tree", "node", "feature", "threshold", "left", "right", "p1")
    if fits_broadcast(table, "node"):
        table = F.broadcast(table)
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "scored")
    roots = nodes.where("depth = 0").select("tree", "node")
    at = rows.select("_row", named.alias("_x")).crossJoin(F.broadcast(roots))  # one row a tree
    for _ in range((nodes.agg(F.max("depth")).first()[0] or 0) + 1):
        at = at.join(table, ["tree", "node"]) if "p1" not in at.columns else (
            at.where("feature IS NOT NULL").select(
                "_row", "_x", "tree",
                F.when(F.element_at("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right")).alias("node"),
            ).join(table, ["tree", "node"]).unionByName(at.where("feature IS NULL"))
        )
        at = stage(at, "walk")
    votes = at.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("tree", "p1"))).alias("_v"))
    return rows.join(votes, "_row").withColumn(out, F.col("_v.p1")).drop("_row", "_v")


def predict(df: DataFrame, nodes: DataFrame, expression_nodes: int = EXPRESSION_NODES) -> DataFrame:
    """Add prediction, probability (of the predicted class), p_dga (the trees' mean) and votes (trees for class 1).

    A tie is class 0. Small node tables become one expression, larger ones are joined.
    """
    few = nodes.limit(expression_nodes + 1).collect()
    scored = _by_expression(df, few, "_p") if len(few) <= expression_nodes else _by_joins(df, nodes, "_p")
    p = F.aggregate("_p", F.lit(0.0), lambda a, b: a + b) / F.size("_p")
    return (
        scored.withColumn("p_dga", p)
        .withColumn("votes", F.size(F.filter("_p", lambda x: x > 0.5)))
        .withColumn("prediction", (F.col("p_dga") > 0.5).cast("int"))
        .withColumn("probability", F.greatest("p_dga", 1 - F.col("p_dga")))
        .drop("_p")
    )


def verdicts(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.select(*keys, decode_label(F.col("prediction")).alias("label"), "probability", "p_dga", "votes")


def saved_nodes(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """The node table of a tree or forest that MLlib saved under ``path``."""
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:  # a forest: one struct a node, beside its tree
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        data = data.withColumn("tree", F.lit(0))
    stats = F.col("impurityStats")
    n, n1 = F.get(stats, F.lit(0)) + F.get(stats, F.lit(1)), F.get(stats, F.lit(1))
    inner = F.col("leftChild") >= 0
    name = F.get(F.array(*[F.lit(c) for c in features]), F.col("split.featureIndex"))
    rows = data.select(
        F.col("tree").cast("int"), F.col("id").cast("string").alias("node"), F.col("id"),
        n.alias("n"), n1.alias("n1"),
        F.when(inner, name).alias("feature"), F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("leftChild").cast("string")).alias("left"), F.when(inner, F.col("rightChild").cast("string")).alias("right"),
        F.col("prediction").cast("int"), (n1 / n).alias("p1"),
    )
    return stage(_depths(rows).select(*NODE_COLUMNS), "tree")


def _depths(rows: DataFrame) -> DataFrame:
    """Depth of each node; children are numbered after their parents, the root 0."""
    links = stage(rows.select("tree", F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("up")).where("node IS NOT NULL"), "links")
    level = rows.where("id = 0").select("tree", "node", F.lit(0).alias("depth"))
    levels, depth = [], 0
    while not (level := stage(level, "level")).isEmpty():
        levels.append(level)
        depth += 1
        level = links.join(level.select("tree", F.col("node").alias("up")), ["tree", "up"]).select("tree", "node", F.lit(depth).alias("depth"))
    return rows.join(reduce(DataFrame.unionByName, levels), ["tree", "node"]) if levels else rows.withColumn("depth", F.lit(0))
