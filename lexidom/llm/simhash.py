"""Near-duplicates by SimHash fingerprints, linked through a vantage-point tree.

Distinct fingerprints are dealt to the leaves of a tree of vantage points. A
fingerprint close to a boundary is also sent, as a visitor, to the leaves that
the triangle inequality cannot rule out, so each pair within the radius meets
in exactly one leaf. Leaves search recursively by the same bounds and return a
spanning forest, never all pairs of a dense group. Components are then found by
star contraction over the links.

Defined cases: a null or wordless text has fingerprint zero, linked like any
other; rows with a null doc_id take part, and a component's id is its smallest
non-null doc_id (null if it has none); repeated rows are each returned; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import shuffle_partitions, stage

SEED = 42
#: Fingerprints the tree is fitted on. Every fingerprint is routed, whatever the sample.
TREE_SAMPLE = 50_000
LEAF_ITEMS = 8_000
BRUTE_FORCE = 1_500


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()  # ASCII letters; spaces 20 and 09 to 0D
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = [digest(joined[s:e], SEED) for s, e in spans]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(octets), 65_536):
        part = np.unpackbits(octets[at : at + 65_536], axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(octets), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (hash of the text), fp: one row per row of ``docs``."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], "<u8")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(fps.view("<i8"))],
                names=["doc_id", "key", "fp"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, "doc_id BIGINT, key BIGINT, fp BIGINT")


@dataclass
class Node:
    """An inner node (vantage point, radius, two children) or, with ``leaf``, a leaf."""

    leaf: int = -1
    point: int = 0
    radius: int = 0
    near: "Node | None" = None
    far: "Node | None" = None


def _distance(fps, point):
    return np.bitwise_count(fps ^ np.uint64(point)).astype(np.int16)


def _choose(fps, reach, rng):
    """Vantage point and radius that leave few items at the boundary, or None."""
    best = None
    for point in rng.choice(fps, min(4, len(fps)), replace=False):
        d = _distance(fps, point)
        radius = int(np.median(d))
        near = int((d <= radius).sum())
        visitors = int(((d > radius - reach) & (d <= radius + reach)).sum())
        if 0.1 * len(fps) <= near <= 0.9 * len(fps) and visitors <= 0.7 * len(fps):
            if best is None or visitors < best[0]:
                best = visitors, point, radius
    return best and best[1:]


def build_tree(sample: np.ndarray, leaf_size: int, reach: int) -> tuple[Node, int]:
    """Tree over a sample; the number of its leaves."""
    rng, leaves = np.random.default_rng(SEED), 0

    def grow(part):
        nonlocal leaves
        found = _choose(part, reach, rng) if len(part) > leaf_size else None
        if found is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        point, radius = found
        near = _distance(part, point) <= radius
        return Node(-1, int(point), radius, grow(part[near]), grow(part[~near]))

    return grow(sample), leaves


def route(node: Node, home: np.ndarray, visit: np.ndarray, reach: int):
    """Yield (leaf, home items, visiting items) for the leaves reached."""
    if not len(home) and not len(visit):
        return
    if node.leaf >= 0:
        yield node.leaf, home, visit
        return
    dh, dv = _distance(home, node.point), _distance(visit, node.point)
    near = dh <= node.radius
    # a pair cut here meets on the far side: its near member goes there as a visitor
    crossing = home[near & (dh + reach > node.radius)]
    yield from route(node.near, home[near], visit[dv - reach <= node.radius], reach)
    yield from route(
        node.far, home[~near], np.concatenate([crossing, visit[dv + reach > node.radius]]), reach
    )


class _Forest:
    """Union of sorted positions, kept as one label per item."""

    def __init__(self, items):
        self.items = np.unique(items)
        self.label = np.arange(len(self.items))

    def link(self, members):
        labels = np.unique(self.label[members])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def edges(self):
        root = self.items[self.label]
        keep = root != self.items
        return root[keep], self.items[keep]


def _search(home, visit, reach, forest, rng):
    if not len(home):
        return
    found = _choose(home, reach, rng) if len(home) > BRUTE_FORCE else None
    if found is not None:
        point, radius = found
        node = Node(-1, int(point), radius, Node(leaf=0), Node(leaf=1))
        for _, h, v in route(node, home, visit, reach):
            _search(h, v, reach, forest, rng)
        return
    everyone = np.concatenate([home, visit])
    at = np.searchsorted(forest.items, everyone)
    step = max(1, 2_000_000 // len(everyone))
    for i in range(0, len(home), step):
        close = np.bitwise_count(home[i : i + step, None] ^ everyone[None, :]) <= reach
        for row in np.flatnonzero(close.sum(axis=1) > 1):
            forest.link(at[close[row]])


def links(fps: DataFrame, reach: int = 2) -> DataFrame:
    """a, b: a spanning forest of the pairs of distinct ``fp`` at most ``reach`` bits apart.

    The tree is fitted on a bounded sample (TREE_SAMPLE); all rows are routed.
    """
    spark = fps.sparkSession
    n = fps.count()
    share = min(1.0, TREE_SAMPLE / max(n, 1))
    picked = fps.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1_000_003)) < int(share * 1_000_003))
    sample = np.array([r.fp for r in picked.collect()], "<i8").view("<u8")
    wanted = max(n // LEAF_ITEMS, 2 * shuffle_partitions(spark))
    tree, _ = build_tree(np.sort(sample), max(16, len(sample) // max(1, wanted)), reach)

    def deal(batches):
        for b in batches:
            home = b.column("fp").to_numpy(zero_copy_only=False).view("<u8")
            for leaf, h, v in route(tree, home, home[:0], reach):
                both = np.concatenate([h, v])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(both), leaf, np.int32)),
                        pa.array(both.view("<i8")),
                        pa.array(np.arange(len(both)) >= len(h)),
                    ],
                    names=["leaf", "fp", "visits"],
                )

    def meet(group: pa.Table) -> pa.Table:
        all_ = group.column("fp").to_numpy().view("<u8")
        visits = group.column("visits").to_numpy()
        forest = _Forest(all_)
        rng = np.random.default_rng(SEED)
        _search(all_[~visits], all_[visits], reach, forest, rng)
        a, b = forest.edges()
        return pa.table({"a": a.view("<i8"), "b": b.view("<i8")})

    dealt = fps.mapInArrow(deal, "leaf INT, fp BIGINT, visits BOOLEAN")
    return dealt.groupBy("leaf").applyInArrow(meet, "a BIGINT, b BIGINT")


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (a, b) with the smallest node reachable.

    Star contraction: each round points the larger neighbours of a node, then the
    smaller ones, at the least node around. Minima are pre-aggregated, so a node
    with very many links makes no long group. Each round is written to the shared folder.
    """

    def minimum(e):
        return e.groupBy("a").agg(F.min("b").alias("least"))

    def seal(e):
        e = stage(e.where("a != b").distinct(), "links")
        return e, e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    e, mark = seal(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = minimum(both).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(
            F.greatest("b", "least").alias("a"), F.least("b", "least").alias("b")
        )
        large = large.where("a != b").distinct()
        small_ = large.join(minimum(large), "a")
        pointed = small_.select("a", F.col("least").alias("b")).unionByName(
            small_.select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        e, after = seal(pointed)
        if after == mark:
            break
        mark = after
    nodes = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """doc_id, key, fp, first (the component's first member: no_id, doc_id, key).

    One row per row of ``docs``; ``key`` is a hash of the text, ``first`` the member
    with the smallest doc_id, null ids last.
    """
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = stage(rows.groupBy("fp").agg(F.min(member).alias("first")), "classes")
    found = components(links(classes.select("fp"), reach))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    by_fp = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    return rows.join(by_fp, "fp").select("doc_id", "key", "fp", "first")
