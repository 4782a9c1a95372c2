"""Hard negatives by threshold joins over an index cut by suffix norms.

Rows are dealt to shards, anchors in blocks to the shards. A shard orders the
dimensions by weight and, for a threshold, indexes of each row only the leading
dimensions: once the norm of a row's remaining suffix times the anchor's norm is
below the threshold, what is left can't reach it alone. Scores are accumulated
dimension by dimension; a pair is dropped when its partial score plus the product
of both remaining norms falls short, and the kept ones are completed from the
omitted suffixes. All rows at or above the threshold come out with exact scores.

Thresholds: an anchor first searches one shard, its home, and lowers the threshold
there until its windows fill. What fills them there bounds the windows' worst
members over all rows, so one pass over all shards at that threshold is exact. This
is done once for the positives and, with their scores, once for the negatives.

Defined cases: rows with a null id, label or vector, or null or non-finite
components take no part; scores beyond a long are cut to its range before they are
compared; vectors of different length don't meet; fewer rows than asked for give
all; equal scores go to the smaller id; repeated rows count one by one as
candidates, once as anchors, and an anchor meets no row of its own id; empty
vectors score zero; other columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shuffle_partitions, stage
from .topk import quantised, usable

SHARD_ROWS = 16_384
ANCHOR_ROWS = 8_192
#: Anchors of similar threshold that share one cut of the index.
BATCH = 64
#: Dimensions taken between two prunings.
STEP = 8
#: First thresholds in the home shard, as shares of the largest score norms allow.
SHARES = [0.8, 0.4, 0.2, 0.1]
#: A window's first thresholds, as shares of the positive's score; the last is its floor.
WINDOW_SHARES = [0.9, 0.7, 0.5]
_LONG = 2**63 - 1


def cut(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, int(score)))


def at_most(score: int) -> float:
    """The score as a double that isn't above it."""
    near = float(score)
    return near if int(near) <= score else float(np.nextafter(near, -np.inf))


class SuffixIndex:
    """Rows of one shard, ready to be searched at any threshold."""

    def __init__(self, ids, labels, vectors):
        self.ids, self.labels = ids, labels
        width = vectors.shape[1]
        # below the limit each product and sum is exact in doubles
        self.limit = int((2**52 / max(width, 1)) ** 0.5)
        plain = (np.abs(vectors.astype(np.float64)) < self.limit).all(axis=1)
        self.outsize = np.flatnonzero(~plain)
        self.rows, self.vectors = np.flatnonzero(plain), vectors
        part = vectors[self.rows].astype(np.float64)
        self.order = np.argsort(-(part**2).sum(axis=0), kind="stable")
        self.columns = np.ascontiguousarray(part[:, self.order].T)
        self.edges = [*range(0, width, STEP), width]
        squares = np.cumsum((self.columns**2)[::-1], axis=0)[::-1]
        none = np.zeros((1, len(self.rows)))
        self.tails = np.sqrt(np.concatenate([squares, none]))[self.edges]
        self.peak = float(self.tails[0].max()) if len(self.rows) else 0.0

    def above(self, asked, least):
        """(place in ``asked``, rows, exact scores) of all that reach its ``least``, some anchors at a time."""
        asked = np.asarray(asked, np.int64).reshape(len(least), -1)
        plain = (np.abs(asked.astype(np.float64)) < self.limit).all(axis=1)
        norms = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(least > 0, least / norms, 0.0)
        ratio = np.nan_to_num(ratio, nan=0.0, posinf=np.inf)
        by_ratio = [i for i in np.argsort(-ratio, kind="stable") if plain[i]]
        for at in range(0, len(by_ratio), BATCH):
            batch = by_ratio[at : at + BATCH]
            for i, (rows, scores) in zip(batch, self._batch(asked[batch], least[batch], ratio[batch].min())):
                yield i, *self._with_outsize(asked[i], least[i], self.outsize, rows, scores)
        none = np.zeros(0, np.int64)
        for i in np.flatnonzero(~plain):
            yield i, *self._with_outsize(asked[i], least[i], range(len(self.ids)), none, none)

    def _with_outsize(self, vector, least, whole, rows, scores):
        """Adds the rows of ``whole`` that reach ``least``, by whole numbers of any size."""
        if not len(whole):
            return rows, scores
        exact = [cut(sum(int(a) * int(b) for a, b in zip(self.vectors[r], vector))) for r in whole]
        big = [(r, s) for r, s in zip(whole, exact) if s >= float(least)]
        more = np.array(big, np.int64).reshape(-1, 2)
        return np.concatenate([rows, more[:, 0]]), np.concatenate([scores, more[:, 1]])

    def _batch(self, asked, least, ratio):
        """``ratio``: least threshold per unit of an asked vector's norm in the batch."""
        query = asked[:, self.order].astype(np.float64)
        squares = np.cumsum((query**2)[:, ::-1], axis=1)[:, ::-1]
        tails = np.sqrt(np.concatenate([squares, np.zeros((len(query), 1))], axis=1))[:, self.edges]
        slack = 1e-9
        floor = np.where(np.isfinite(least), least - slack * np.abs(least) - 1e-3, least)[:, None]
        steps = len(self.edges) - 1
        # index of a row: its first so many steps; the suffix beyond can't reach alone
        lengths = (self.tails[:steps] * (1 + slack) >= ratio).sum(axis=0)
        rows = np.flatnonzero(lengths > 0) if steps else np.arange(len(self.rows))
        rows = rows[np.argsort(-lengths[rows], kind="stable")]
        scores = np.zeros((len(query), len(rows)))
        reach = np.full(scores.shape, np.inf)
        for step in range(steps):
            listed = int((lengths[rows] > step).sum())
            if not listed:
                break
            dims = slice(self.edges[step], self.edges[step + 1])
            scores[:, :listed] += query[:, dims] @ self.columns[dims, rows[:listed]]
            done = np.minimum(lengths[rows], step + 1)
            reach = scores + tails[:, done] * self.tails[done, rows] * (1 + slack)
            keep = (reach >= floor).any(axis=0)
            if keep.sum() < 0.75 * len(keep):
                rows, scores, reach = rows[keep], scores[:, keep], reach[:, keep]
        who, what = np.nonzero(reach >= floor)
        sums, where = scores[who, what], rows[what]
        for length in np.unique(lengths[where]):
            if length < steps:  # the omitted suffix
                at = np.flatnonzero(lengths[where] == length)
                dims = slice(self.edges[length], None)
                for some in np.array_split(at, len(at) // 65_536 + 1):
                    sums[some] += np.einsum("ij,ji->i", query[who[some], dims], self.columns[dims, where[some]])
        good = sums >= least[who]
        who, where, sums = who[good], where[good], sums[good].astype(np.int64)
        ends = np.searchsorted(who, np.arange(len(query) + 1))
        return [(self.rows[where[a:b]], sums[a:b]) for a, b in zip(ends, ends[1:])]


def best(index: SuffixIndex, rows, scores, k: int):
    """The k best of rows, by score, then id."""
    order = np.lexsort((index.ids[rows], -scores))[:k]
    return rows[order], scores[order]


def positives_of(index: SuffixIndex, ask: list[dict], k: int, home: bool) -> list[tuple]:
    """(ask, id, score) of up to k best rows of each anchor's own label; ``index`` holds that label."""
    out, open_ = [], ask
    for share in [*SHARES, None] if home else [None]:
        norms = [float(np.sqrt((a["vector"].astype(np.float64) ** 2).sum())) for a in open_]
        if home:
            least = np.array([-np.inf if share is None else share * n * index.peak for n in norms])
        else:
            least = np.array([-np.inf if a["least"] is None else at_most(a["least"]) for a in open_])
        unfilled = []
        for i, rows, scores in index.above([a["vector"] for a in open_], least):
            a = open_[i]
            other = index.ids[rows] != a["anchor_id"]
            rows, scores = best(index, rows[other], scores[other], k)
            if len(rows) < k and share is not None:
                unfilled.append(a)
            else:
                out += [(a, int(index.ids[r]), int(s)) for r, s in zip(rows, scores)]
        open_ = unfilled
        if not open_:
            break
    return out


def negatives_of(index: SuffixIndex, ask: list[dict], k: int, home: bool) -> list[tuple]:
    """(ask, place, id, score): up to k best rows of other labels in each positive's window."""
    out, open_ = [], [(a, a["windows"]) for a in ask]
    for share in WINDOW_SHARES if home else [None]:
        least = []
        for a, windows in open_:
            lows = [w["score"] * share if home else at_most(w["least"]) for w in windows]
            least.append(min(lows))
        unfilled = []
        for i, rows, scores in index.above([a["vector"] for a, _ in open_], np.array(least)):
            a, windows = open_[i]
            other = (index.ids[rows] != a["anchor_id"]) & (index.labels[rows] != a["label"])
            rows, scores = best(index, rows[other], scores[other], len(rows))
            left = []
            for w in windows:
                low, high = -(-w["score"] // 2), 95 * w["score"] // 100
                start, end = len(scores) - np.searchsorted(scores[::-1], [high, low - 1], side="right")
                inside = range(start, min(end, start + k))
                if home and len(inside) < k and share != WINDOW_SHARES[-1]:
                    left.append(w)
                else:
                    out += [(a, w["place"], int(index.ids[rows[j]]), int(scores[j])) for j in inside]
            if left:
                unfilled.append((a, left))
        open_ = unfilled
        if not open_:
            break
    return out


def _rows_of(part: pa.Table, id_: str, label: str, vector: str):
    ids = part.column(id_).to_numpy()
    flat = part.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // len(ids) if len(ids) else 0
    return ids, part.column(label).to_numpy(), flat.astype(np.int64).reshape(len(ids), width)


def _search(items: DataFrame, asked: DataFrame, what: str, k: int, home: bool) -> DataFrame:
    """Meet shards and blocks of anchors; ``asked`` has a column shard."""

    def by_shard(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            ids, labels, vectors = _rows_of(left, "id", "label", "vector")
            anchors, own, wanted = _rows_of(right, "anchor_id", "own_label", "anchor")
            extra = right.column("state").to_pylist()
            keys = right.column("anchor_key").to_pylist()
            ask = [
                {"anchor_id": int(a), "key": key, "label": int(b), "vector": v, **(e or {})}
                for a, key, b, v, e in zip(anchors, keys, own, wanted, extra)
            ]
            if what == "positives":
                found = []
                ask.sort(key=lambda a: a["label"])
                for label, same in groupby(ask, key=lambda a: a["label"]):
                    at = labels == label
                    if at.any():
                        index = SuffixIndex(ids[at], labels[at], vectors[at])
                        found += [(a, 0, i, s) for a, i, s in positives_of(index, list(same), k, home)]
            else:
                found = negatives_of(SuffixIndex(ids, labels, vectors), ask, k, home)
            for a, place, i, s in found:
                for column, x in zip(out, (a["anchor_id"], a["key"], place, i, s)):
                    column.append(x)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        names = ["anchor_id", "anchor_key", "place", "id", "score"]
        return pa.table([pa.array(x, t) for x, t in zip(out, types)], names=names)

    keys = ["shard", "block", "width"]
    return (
        items.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(by_shard, "anchor_id BIGINT, anchor_key BIGINT, place INT, id BIGINT, score BIGINT")
    )


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` holds id, label and vector (array of longs) without nulls; ``anchors``
    tells which of them ask. Negatives score from half of the positive's score to
    95 hundredths of it.
    """
    spark = rows.sparkSession
    placed = stage(rows.select("id", "label", "vector", F.monotonically_increasing_id().alias("place")), "vectors")
    asking = placed.where(anchors).select("id", "label", "vector").distinct()
    n, q = placed.count(), asking.count()
    shards = max(1, -(-n // shard_rows), min(shuffle_partitions(spark), -(-n // 512)))
    blocks = max(1, -(-q // ANCHOR_ROWS))
    width = F.size("vector").alias("width")
    items = placed.select(
        "id", "label", "vector", width, F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    key = F.xxhash64("label", "vector")
    asking = stage(
        asking.select(
            F.col("id").alias("anchor_id"), key.alias("anchor_key"), F.col("label").alias("own_label"),
            F.col("vector").alias("anchor"), width, F.pmod(F.xxhash64("id", key), F.lit(blocks)).cast("int").alias("block"),
        ),
        "anchors",
    )
    one = ["anchor_id", "anchor_key"]
    home = F.pmod(F.xxhash64("anchor_key", "anchor_id"), F.lit(shards)).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")

    nothing = F.lit(None).cast("struct<least:bigint>").alias("state")
    near = _search(items, asking.select("*", home, nothing), "positives", n_positives, True)
    floors = near.groupBy(*one).agg(F.count("*").alias("n"), F.min("score").alias("low"))
    least = F.struct(F.when(F.col("n") >= n_positives, F.col("low")).alias("least")).alias("state")
    asked = asking.join(floors, one, "left").select(*asking.columns, every, least)
    positives = stage(
        _ranked(_search(items, asked, "positives", n_positives, False), one, n_positives).select(
            *one, F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )

    windows = positives.where("positive_score >= 0")  # below zero a window's floor is above its top
    window = F.struct("place", F.col("positive_score").alias("score"))
    states = windows.groupBy(*one).agg(F.collect_list(window).alias("windows"))
    asked = asking.join(states, one).select(*asking.columns, home, F.struct("windows").alias("state"))
    near = _search(items, asked, "negatives", n_negatives, True)
    floors = near.groupBy(*one, "place").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    low = F.when(F.col("n") >= n_negatives, F.col("low")).otherwise(F.expr("positive_score div 2"))
    window = F.struct("place", F.col("positive_score").alias("score"), low.alias("least"))
    states = windows.join(floors, [*one, "place"], "left").groupBy(*one).agg(F.collect_list(window).alias("windows"))
    asked = asking.join(states, one).select(*asking.columns, every, F.struct("windows").alias("state"))
    found = _search(items, asked, "negatives", n_negatives, False)
    return (
        _ranked(found, [*one, "place"], n_negatives)
        .join(positives, [*one, "place"])
        .select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )


def mine_embeddings(
    vectors: DataFrame, every: int = 50, moved: int = 7, scale: int = 256, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``mine`` over vec_id, label and embedding; where ``moved`` divides vec_id, the label moves on by one of ten."""
    label = F.col("label").cast("bigint")
    rows = vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    ).select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % moved == 0, (label + 1) % 10).otherwise(label).alias("label"),
        quantised(F.col("embedding"), scale).alias("vector"),
    )
    return mine(rows, F.col("id") % every == 0, shard_rows=shard_rows)
