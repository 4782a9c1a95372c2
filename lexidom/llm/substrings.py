"""Removal of word windows that occur more than once, by Rabin-Karp hashes.

Each document lies in a block (by a hash of the row). A block hashes all its
windows, keeps each hash once and sends it to the bucket that a second hash
names; buckets hold a fixed number of windows, so the two hashes together grow
with the data: 64 bits and the logarithm of the number of buckets. A bucket
counts the blocks of each hash and sends one bit per entry back to the block,
which marks the windows and merges them into maximal intervals. A very common
window is one entry per block.

Defined cases: null text has no words; texts shorter than a window keep all
words; repeated rows count as places of their own, as two rows of one text are
two documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import shuffle_partitions

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 6 << 20  # of text, about a million windows
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd multipliers of the two hashes
KEPT_WORDS = 400_000


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 1)
        return value


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` words, by doubling."""
    base &= (1 << 64) - 1
    power, done, tail = 1, 0, None
    run = words
    while True:
        if size & power:
            if tail is None:
                tail = run
            else:
                scale = np.uint64(pow(base, done, 1 << 64))
                n = min(len(run), len(tail) - power)
                tail = run[:n] * scale + tail[power : power + n]
            done += power
        if done == size:
            return tail
        scale = np.uint64(pow(base, power, 1 << 64))
        run = run[:-power] * scale + run[power:]
        power *= 2


def _mixed(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def block_windows(texts, window, buckets, cache):
    """Words per text, and start, hash and bucket of each window of the block."""
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    words = np.fromiter((cache[w] for ws in split for w in ws), np.uint64, total)
    if total < window:
        none = np.zeros(0, np.int64)
        return split, sizes, none, none.astype(np.uint64), none
    ends = np.cumsum(sizes)
    last = np.repeat(ends, sizes) - window  # of the text each word lies in
    starts = np.flatnonzero(np.arange(total) <= last)
    one = rolling(words, window, BASES[0])[starts]
    two = _mixed(rolling(words, window, BASES[1])[starts])
    return split, sizes, starts, _mixed(one), (two % np.uint64(buckets)).astype(np.int64)


def _entries(hashes, bucket):
    """Order of the distinct (bucket, hash), places of their first, and each window's entry."""
    order = np.lexsort((hashes, bucket))
    h, b = hashes[order], bucket[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    entry = np.empty(len(h), np.int64)
    entry[order] = np.cumsum(fresh) - 1
    return h[fresh], b[fresh], entry


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, spans (start, end: removed word ranges), kept (text left).

    Words are runs without ASCII white space. A word goes if some window of
    ``window`` words over it also starts elsewhere in the table, judged on the input.
    """
    spark = docs.sparkSession
    shuffles = shuffle_partitions(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(4 * shuffles, size // BLOCK_BYTES)
    buckets = max(shuffles, size // BUCKET_BYTES)
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"),
        "doc_id",
        F.col("text").cast("binary").alias("text"),
    )

    def send(group: pa.Table) -> pa.Table:
        texts = group.column("text").to_pylist()
        _, _, _, hashes, bucket = block_windows(texts, window, buckets, _WordHashes())
        h, b, _ = _entries(hashes, bucket)
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        parts = np.split(h, cuts[1:]) if len(b) else []
        block = group.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(parts), pa.int64()),
                "bucket": pa.array(b[cuts]),
                "data": pa.array([p.tobytes() for p in parts], pa.binary()),
            }
        )

    def count(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in group.column("data").to_pylist()]
        every = np.sort(np.concatenate(parts))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out_block, out_data = [], []
        if len(twice):
            for block, part in zip(group.column("block").to_pylist(), parts):
                at = np.minimum(np.searchsorted(twice, part), len(twice) - 1)
                hit = twice[at] == part
                if hit.any():
                    out_block.append(block)
                    out_data.append(np.packbits(hit).tobytes())
        bucket = group.column("bucket")[0].as_py()
        return pa.table(
            {
                "block": pa.array(out_block, pa.int64()),
                "bucket": pa.array([bucket] * len(out_block), pa.int64()),
                "data": pa.array(out_data, pa.binary()),
            }
        )

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").to_pylist()
        split, sizes, starts, hashes, bucket = block_windows(texts, window, buckets, _WordHashes())
        gone = np.zeros(int(sizes.sum()) + 1, np.int64)
        if len(starts):
            h, b, entry = _entries(hashes, bucket)
            repeated = np.bincount(entry, minlength=len(h)) > 1
            if right.num_rows:
                asked = right.column("bucket").to_numpy()
                lo, hi = np.searchsorted(b, asked), np.searchsorted(b, asked, side="right")
                for s, e, bits in zip(lo, hi, right.column("data").to_pylist()):
                    flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(e - s))
                    repeated[s:e] |= flags.astype(bool)
            hit = starts[repeated[entry]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        covered = np.cumsum(gone)[:-1] > 0
        spans, kept, at = [], [], 0
        for words in split:
            mask = covered[at : at + len(words)]
            at += len(words)
            edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
            spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
            if len(edges):
                words = [w for w, m in zip(words, mask.tolist()) if not m]
            kept.append(b" ".join(words))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "n_words": pa.array(sizes),
                "spans": pa.array(spans, span),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    wire = "block BIGINT, bucket BIGINT, data BINARY"
    sent = rows.groupBy("block").applyInArrow(send, wire)
    back = sent.groupBy("bucket").applyInArrow(count, wire)
    return (
        rows.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInArrow(
            cut, "doc_id BIGINT, n_words BIGINT, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, kept STRING"
        )
    )
