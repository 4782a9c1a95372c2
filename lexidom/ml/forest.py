"""Random forests over counted cells of binned features.

Rows in the same bins with the same label are one cell with a count, so a level's work
follows the cells, not the rows. A tree draws each cell Poisson(count) times, which is
what one Poisson(1) draw per row adds up to; draws follow the cell, the tree and the
seed, whatever the partitions. A level is one job: tasks count the drawn rows of their
cells by node, feature and bin, one group per tree adds the counts and takes the splits
of the largest Gini gain, and the driver sees the chosen splits only.

Defined cases: labels are 0 or 1; null or NaN features fail the job; a tie of splits goes to
the first; leaves vote with the class shares of their rows, as MLlib's do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

BITS = 5  # of a bin number
BINS = 1 << BITS
#: Cells that are worth a task of their own, and the most that one task holds.
CELLS, MOST_CELLS = 20_000, 1_000_000
_SPLITS = "tree INT, node INT, feature INT, cut INT, left0 BIGINT, left1 BIGINT, right0 BIGINT, right1 BIGINT"


def _limits_of(rows: DataFrame, features: list[str], parts: list[Column]) -> list[list[np.ndarray]]:
    """Per part of the rows, upper limits of all bins but the last: every value where they are few, else
    quantiles of all its rows. All parts are summed up in the same passes."""
    of = lambda i, c: F.when(parts[i], F.col(c).cast("double"))
    places = [(i, c) for i in range(len(parts)) for c in features]
    steps = [j / BINS for j in range(1, BINS)]
    found = rows.agg(
        *[F.percentile_approx(of(i, c), steps, 1000).alias(f"q{i}_{c}") for i, c in places],
        *[F.approx_count_distinct(of(i, c), 0.02).alias(f"k{i}_{c}") for i, c in places],
    ).first().asDict()
    limits = {(i, c): found[f"q{i}_{c}"] or [] for i, c in places}
    few = [(i, c) for i, c in places if found[f"k{i}_{c}"] <= 2 * BINS]
    if few:
        sets = rows.agg(*[F.collect_set(of(i, c)).alias(f"v{i}_{c}") for i, c in few]).first().asDict()
        for i, c in few:
            if len(sets[f"v{i}_{c}"]) <= BINS:
                limits[i, c] = sorted(sets[f"v{i}_{c}"])[:-1]
    return [[np.unique(np.array(limits[i, c], "float64")) for c in features] for i in range(len(parts))]


def _limits(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    return _limits_of(rows, features, [F.lit(True)])[0]


def _bins(columns, limits: list[np.ndarray]) -> np.ndarray:
    """Number of the bin of each value, one column per feature."""
    x = np.empty((len(columns[0]), len(limits)), "uint8")
    for i, (values, limit) in enumerate(zip(columns, limits)):
        values = np.asarray(values, "float64")
        if np.isnan(values).any():
            raise ValueError("null or NaN feature")
        x[:, i] = np.searchsorted(limit, values)
    return x


def _packed(batch: pd.DataFrame, features: list[str], limits: list[np.ndarray]) -> np.ndarray:
    """The bins and the label of each row in one number."""
    cell = batch["label"].to_numpy("int64")
    for i, x in enumerate(_bins([batch[c] for c in features], limits).T):
        cell = cell | (x.astype("int64") << (1 + BITS * i))
    return cell


def _unpacked(cell: np.ndarray, n_features: int) -> np.ndarray:
    return np.stack([(cell >> (1 + BITS * i)) & (BINS - 1) for i in range(n_features)], 1).astype("uint8")


def _cells(rows: DataFrame, features: list[str], limits: list[np.ndarray]) -> DataFrame:
    """cell, n: the bins and the label in one number, and its rows."""
    def packed(batches):
        for b in batches:
            if len(b):
                cell, n = np.unique(_packed(b, features, limits), return_counts=True)
                yield pd.DataFrame({"cell": cell, "n": n})

    parts = rows.select("label", *features).mapInPandas(packed, "cell BIGINT, n BIGINT")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"))


class Tally:
    """Rows counted in cells (cell, n) of the bins of ``features``."""

    def __init__(self, features: list[str], limits: list[np.ndarray], cells: DataFrame):
        if 1 + BITS * len(features) > 63:
            raise ValueError("too many features for one cell number")
        self.features, self.limits, self.cells = list(features), limits, cells

    def of(self, features: list[str]) -> Tally:
        """The same rows, counted by some of the features."""
        if list(features) == self.features:
            return self
        places = [self.features.index(c) for c in features]
        code = F.col("cell").bitwiseAND(F.lit(1))
        for i, place in enumerate(places):
            x = F.shiftright("cell", 1 + BITS * place).bitwiseAND(F.lit(BINS - 1))
            code = code.bitwiseOR(F.shiftleft(x, 1 + BITS * i))
        cells = self.cells.groupBy(code.alias("cell")).agg(F.sum("n").alias("n"))
        return Tally(features, [self.limits[i] for i in places], cells)


def tallied(rows: DataFrame, features: list[str], parts: list[Column]) -> list[tuple[Tally, Tally]]:
    """Per part, the tallies of its rows and of all other rows, both by the part's own limits.

    The rows are read for the limits and for the cells of all parts at once, so a
    comparison reads them a fixed number of times, however many models it fits.
    """
    Tally(features, [], rows)  # refuses too many features
    limits = _limits_of(rows, features, parts)
    mark = F.lit(0).cast("bigint")
    for i, part in enumerate(parts):
        mark = mark.bitwiseOR(F.when(part, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))

    def packed(batches):
        for b in batches:
            if not len(b):
                continue
            mark = b["_parts"].to_numpy("int64")
            for i, limit in enumerate(limits):
                own = (mark >> i) & 1
                code, n = np.unique(_packed(b, features, limit) * 2 + own, return_counts=True)
                yield pd.DataFrame({"part": i, "own": code & 1 == 1, "cell": code >> 1, "n": n})

    counts = rows.select("label", *features, mark.alias("_parts")).mapInPandas(
        packed, "part INT, own BOOLEAN, cell BIGINT, n BIGINT"
    )
    table = stage(counts.groupBy("part", "own", "cell").agg(F.sum("n").alias("n")), "cells")
    tally = lambda i, own: Tally(
        features, limits[i], table.where((F.col("part") == i) & (F.col("own") == own)).select("cell", "n")
    )
    return [(tally(i, True), tally(i, False)) for i in range(len(parts))]


def _uniform(cell: np.ndarray, seed: int) -> np.ndarray:
    """A number from [0, 1) per cell (splitmix64)."""
    with np.errstate(over="ignore"):
        z = cell.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def poisson(n: np.ndarray):
    """A function from uniform numbers to Poisson(n) draws, by the inverse distribution."""
    sizes, which = np.unique(n, return_inverse=True)
    tables, starts, lows, at = [], [], [], 0
    for i, mean in enumerate(sizes.tolist()):
        reach = 12 * math.sqrt(mean) + 20
        low = max(0, int(mean - reach))
        log = [k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(low, int(mean + reach))]
        tables.append(i + np.minimum(np.cumsum(np.exp(log)), 1.0 - 1e-12))
        starts.append(at)
        lows.append(low)
        at += len(log)
    table, shift = np.concatenate(tables), (np.array(lows) - np.array(starts))[which]
    # a table's last place is never passed
    last = np.append(starts[1:], at)[which] - 1
    return lambda u: np.minimum(np.searchsorted(table, which + u, side="right"), last) + shift


class Tree:
    """Nodes by number: a row goes from one to left, or to left + 1 if its bin is above the cut; leaves stay."""

    def __init__(self):
        self.feature, self.cut = np.zeros(1, "int32"), np.full(1, BINS, "int32")
        self.left, self.share = np.zeros(1, "int32"), np.full(1, 0.5)

    def walk(self, x: np.ndarray, steps: int) -> np.ndarray:
        node, row = np.zeros(len(x), "int32"), np.arange(len(x))
        for _ in range(steps):
            node = self.left[node] + (x[row, self.feature[node]] > self.cut[node])
        return node

    def grow(self, node: np.ndarray, splits: pd.DataFrame) -> np.ndarray:
        """Puts the splits at the nodes; gives the children that hold both classes."""
        left, right = splits[["left0", "left1"]].to_numpy(), splits[["right0", "right1"]].to_numpy()
        if len(self.left) == 1:
            whole = (left + right)[0]
            self.share[0] = whole[1] / whole.sum()
        split = (splits["feature"] >= 0).to_numpy()
        node, left, right = node[splits["node"].to_numpy()[split]], left[split], right[split]
        size, ends = len(self.left), np.stack([left, right], 1).reshape(-1, 2)
        child = size + np.arange(len(ends), dtype="int32")
        self.feature[node], self.cut[node] = splits["feature"].to_numpy()[split], splits["cut"].to_numpy()[split]
        self.left[node] = child[::2]
        self.feature = np.append(self.feature, np.zeros(len(ends), "int32"))
        self.cut = np.append(self.cut, np.full(len(ends), BINS, "int32"))
        self.left = np.append(self.left, child)
        self.share = np.append(self.share, ends[:, 1] / ends.sum(1))
        return child[(ends > 0).all(1)]


def _level(cells: DataFrame, trees, opened, chosen, depth: int, n_features: int, seeds, bootstrap) -> pd.DataFrame:
    """The best split of every open node, by tree and place among the tree's open nodes."""
    m = len(chosen[next(t for t, nodes in enumerate(opened) if len(nodes))][0])

    def counted(batches):
        held = [(b["cell"].to_numpy(), b["n"].to_numpy()) for b in batches if len(b)]
        if not held:
            return
        cell, n = (np.concatenate(c) for c in zip(*held))
        label, draw = cell & 1, poisson(n) if bootstrap else None
        x = _unpacked(cell, n_features)
        for t, nodes in enumerate(opened):
            if not len(nodes):
                continue
            weight = draw(_uniform(cell, seeds[t])) if bootstrap else n
            drawn = np.flatnonzero(weight)
            place = np.full(len(trees[t].left), -1, "int64")
            place[nodes] = np.arange(len(nodes))
            at = place[trees[t].walk(x[drawn], depth)]
            drawn, at = drawn[at >= 0], at[at >= 0]
            size, counts = len(nodes) * m * BINS * 2, 0
            for j in range(m):
                code = ((at * m + j) * BINS + x[drawn, chosen[t][at, j]]) * 2 + label[drawn]
                counts = counts + np.bincount(code, weight[drawn], size)
            yield pd.DataFrame({"tree": [t], "counts": [counts.astype("int64").tobytes()]})

    def best(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        t = key[0]
        k = len(opened[t])
        counts = sum(np.frombuffer(c, "int64") for c in parts["counts"]).reshape(k, m, BINS, 2)
        left = counts.cumsum(2)
        whole = left[:, :1, -1:, :]
        right = whole - left
        n_left, n_right = left.sum(3), right.sum(3)

        # the larger these sums of squares, the smaller the children's Gini impurity
        def purity(c, n):
            return (c.astype("float64") ** 2).sum(3) / np.maximum(n, 1)

        gain = purity(left, n_left) + purity(right, n_right) - purity(whole, whole.sum(3))
        gain = np.where((n_left > 0) & (n_right > 0), gain, -1.0).reshape(k, -1)
        top = gain.argmax(1)
        row = np.arange(k)
        feature, cut = chosen[t][row, top // BINS], top % BINS
        ok = gain[row, top] > 1e-9 * whole.sum(3)[:, 0, 0]
        l, r = left[row, top // BINS, cut], right[row, top // BINS, cut]
        return pd.DataFrame({
            "tree": t, "node": row, "feature": np.where(ok, feature, -1), "cut": cut,
            "left0": l[:, 0], "left1": l[:, 1], "right0": r[:, 0], "right1": r[:, 1],
        })

    parts = cells.mapInPandas(counted, "tree INT, counts BINARY")
    return parts.groupBy("tree").applyInPandas(best, _SPLITS).toPandas()


def _votes(trees: list[Tree], x: np.ndarray, depth: int) -> np.ndarray:
    """The trees' votes for class 1, each a share."""
    one = np.zeros(len(x))
    for tree in trees:
        one += tree.share[tree.walk(x, depth)]
    return one


class ForestModel:
    def __init__(self, features: list[str], limits: list[np.ndarray], trees: list[Tree], depth: int):
        self.features, self.limits, self.trees, self.depth = features, limits, trees, depth

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds rawPrediction (the classes' votes), probability (their shares) and prediction."""
        limits, trees, depth = self.limits, self.trees, self.depth

        def votes(*columns: pd.Series) -> pd.Series:
            x = _bins(columns, limits)
            one = _votes(trees, x, depth)
            return pd.Series(list(np.stack([len(trees) - one, one], 1)))

        voted = F.pandas_udf(votes, "array<double>")
        shares = F.transform("_forest_votes", lambda v: v / len(trees))
        return rows.withColumn("_forest_votes", voted(*[F.col(c).cast("double") for c in self.features])).withColumns({
            "rawPrediction": array_to_vector("_forest_votes"), "probability": array_to_vector(shares),
            "prediction": (F.get("_forest_votes", F.lit(1)) > F.get("_forest_votes", F.lit(0))).cast("double"),
        }).drop("_forest_votes")

    def tested(self, tally: Tally) -> DataFrame:
        """label, prediction, n: the rows of a tally by this model's bins; a tie is class 0."""
        trees, depth, k = self.trees, self.depth, len(self.features)
        if tally.features != self.features:
            raise ValueError("the tally has other features than the model")

        def predicted(cells: pd.Series) -> pd.Series:
            one = _votes(trees, _unpacked(cells.to_numpy(), k), depth)
            return pd.Series((one > len(trees) - one).astype("int32"))

        label = F.col("cell").bitwiseAND(F.lit(1)).cast("int")
        return tally.cells.select(label.alias("label"), F.pandas_udf(predicted, "int")("cell").alias("prediction"), "n")


class Forest:
    """Grows ``n_estimators`` trees of at most ``max_depth`` levels; a node looks at the square root of the features.

    Without ``bootstrap`` every tree learns from each row once and a node looks at all features:
    one such tree is a plain decision tree.
    """

    def __init__(self, features: list[str], n_estimators: int, max_depth: int, seed: int, bootstrap: bool = True):
        if 1 + BITS * len(features) > 63:
            raise ValueError("too many features for one cell number")
        self.features, self.n_estimators, self.max_depth, self.seed = list(features), n_estimators, max_depth, seed
        self.bootstrap = bootstrap

    def fit(self, rows: DataFrame) -> ForestModel:
        limits = _limits(rows, self.features)
        return self.grow(Tally(self.features, limits, stage(_cells(rows, self.features, limits), "cells")))

    def grow(self, tally: Tally) -> ForestModel:
        """The model of rows that are counted already."""
        if tally.features != self.features:
            raise ValueError("the tally has other features than the model")
        limits, cells = tally.limits, tally.cells
        n = cells.count()
        if not n:
            raise ValueError("no rows to learn from")
        cores = cells.sparkSession.sparkContext.defaultParallelism
        cells = stage(cells.repartition(max(min(cores, -(-n // CELLS)), -(-n // MOST_CELLS)), "cell"), "cells")
        seeds = np.random.SeedSequence(self.seed).generate_state(self.n_estimators, "uint64").tolist()
        trees = [Tree() for _ in seeds]
        opened = [np.zeros(1, "int32") for _ in seeds]
        k = len(self.features)
        m = math.ceil(math.sqrt(k)) if self.bootstrap else k
        for depth in range(self.max_depth):
            if not any(len(nodes) for nodes in opened):
                break
            chosen = [
                np.random.default_rng([seed, depth]).random((len(nodes), k)).argsort(1)[:, :m] if m < k
                else np.tile(np.arange(k), (len(nodes), 1))
                for seed, nodes in zip(seeds, opened)
            ]
            found = dict(iter(_level(cells, trees, opened, chosen, depth, k, seeds, self.bootstrap).groupby("tree")))
            opened = [
                trees[t].grow(nodes, found[t]) if t in found else nodes[:0] for t, nodes in enumerate(opened)
            ]
        return ForestModel(self.features, limits, trees, self.max_depth)
