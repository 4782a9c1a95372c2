"""Exact top-k by inner product with the threshold algorithm.

Vectors are dealt to shards, queries in blocks to each shard. A shard keeps one
sorted list per dimension. A query walks the lists from the end its sign asks
for, scores each vector when it first appears in any list, and stops when the
score that an unseen vector could still reach is below its k-th best. The best of
the shards are merged by a grouped ranking.

Defined cases: vectors that are null, or hold null or non-finite components, and
rows with a null id, take no part; scores beyond a long are cut to its range;
vectors of different length don't meet; fewer candidates than k give all; equal
scores go to the smaller id; repeated rows count one by one as candidates, once
as queries, and a query doesn't meet rows of its own id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shuffle_partitions, stage

SHARD_ROWS = 4_096
QUERY_ROWS = 1_024
FIRST_DEPTH = 16


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as longs."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(embedding: Column) -> Column:
    bad = F.exists(
        embedding,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return embedding.isNotNull() & ~bad


class SortedLists:
    """One list of rows per dimension, ascending, and each row's place in it."""

    def __init__(self, ids, vectors):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        n, width = vectors.shape
        self.places = np.empty((2 * width, n), np.int32)  # from the start, then from the end
        for j in range(width):
            self.places[j, self.order[:, j]] = np.arange(n, dtype=np.int32)
        self.places[width:] = n - 1 - self.places[:width]
        self.peak = max(abs(int(vectors.max())), abs(int(vectors.min()))) if vectors.size else 0
        self.doubles = vectors.astype(np.float64)

    def top(self, own, query, k):
        """Indices and scores of the k best rows whose id isn't ``own``."""
        n, used = len(self.ids), np.flatnonzero(query)
        # doubles are exact below 2^53; beyond, Python's integers are
        exact = self.peak * float(np.abs(query.astype(np.float64)).sum()) < 2**52
        vectors = self.doubles if exact else self.vectors
        query = query.astype(np.float64 if exact else object)

        def score(part, weights):
            return part @ weights if exact else part.astype(object) @ weights

        down = query[used] > 0  # such lists are read from their end
        if len(used):
            at = self.places[used + np.where(down, self.vectors.shape[1], 0)].min(axis=0)
        else:
            at = np.zeros(n, np.int32)
        by_depth = np.argsort(at, kind="stable")
        deep = at[by_depth]
        rows, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        depth, seen = min(FIRST_DEPTH, n), 0
        while True:
            upto = int(np.searchsorted(deep, depth))
            fresh = by_depth[seen:upto]
            fresh = fresh[self.ids[fresh] != own]
            seen = upto
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, score(vectors[fresh], query)])
            if exact:
                best = np.lexsort((self.ids[rows], -scores))[:k]
            else:
                best = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
            best = np.array(best, np.int64)
            rows, scores = rows[best], scores[best]
            if seen >= n:
                return rows, scores
            edge = np.where(down, n - depth, depth - 1)
            bound = score(vectors[self.order[edge, used], used], query[used])
            if len(rows) == k and scores[-1] > bound:
                return rows, scores
            depth = min(n, depth * 4)


def top_k(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, query_key, rank, id, score; both tables hold id and vector (array of longs)."""
    spark = items.sparkSession
    n, q = items.count(), queries.count()
    shards = max(-(-n // SHARD_ROWS), min(shuffle_partitions(spark), -(-n // 256)), 1)
    blocks = max(1, -(-q // QUERY_ROWS))
    width = F.size("vector").alias("width")
    dealt = items.select(
        "id", "vector", width, F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    asked = queries.select(  # new names: both tables may come from one
        F.col("id").alias("query_id"), F.col("vector").alias("query"), width,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"),
        F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int").alias("block"),
    )

    def read(part: pa.Table, id_, vector):
        if not part.num_rows:  # the other side of the group alone
            return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
        ids = part.column(id_).to_numpy()
        flat = part.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return ids, flat.astype(np.int64).reshape(len(ids), -1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors = read(left, "id", "vector")
        asked_ids, wanted = read(right, "query_id", "query")
        out = [[], [], [], []]
        if len(ids) and len(asked_ids):
            lists = SortedLists(ids, vectors)
            for i, own in enumerate(asked_ids):
                rows, scores = lists.top(own, wanted[i], k)
                out[0] += [int(own)] * len(rows)
                out[1] += [wanted[i].tobytes()] * len(rows)
                out[2] += ids[rows].tolist()
                out[3] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table(
            [pa.array(x, t) for x, t in zip(out, types)], names=["query_id", "query", "id", "score"]
        )

    keys = ["shard", "block", "width"]
    found = (
        dealt.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(search, "query_id BIGINT, query BINARY, id BIGINT, score BIGINT")
        .withColumn("query_key", F.xxhash64("query"))
    )
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "query_key", "rank", "id", "score")


def search_embeddings(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose vec_id ``every`` divides, against all rows."""
    rows = stage(
        vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").alias("id"), quantised(F.col("embedding"), scale).alias("vector")
        ),
        "vectors",
    )
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).distinct()
    return top_k(rows, queries, k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score"
    )
