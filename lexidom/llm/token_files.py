"""Token ids of a corpus in files of blocks, coded by length-limited Huffman codes.

A folder of token files holds three tables:

* ``codes``: id and number of bits. Codes are canonical (ascending by bits, then id),
  so the lengths are the whole code book. Lengths come from package-merge over the
  counts of all ids and stay within a limit, so one table lookup decodes any code.
* ``blocks``: one row per block of a part: part, block, place of its first id in the
  part, number of ids, the bit string (most significant bit first), the bit offset of
  each 64th id, and the id and length of the documents that start in it. A block is
  decoded from the code book and itself alone, from any of its bit offsets on.
* ``parts``: part, number of ids, place of its first id in the whole.

Documents stand in ascending order of doc_id; parts are the ranges of the sort.

Defined cases: a null text is an empty one, of which the end id is all; a null doc_id
comes first; equal doc_ids are ordered by a hash of their ids; repeated rows are
written again; texts of any length are encoded whole and may span blocks; an empty
table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path, stage

BLOCK_IDS = 262_144
#: Ids between two bit offsets of a block.
MARK_IDS = 64
#: Bits of the longest code, unless the ids are too many for it.
MOST_BITS = 16
#: Encoded words, and pieces of words, a worker remembers.
CACHED_WORDS = 1_000_000
CACHED_LENGTH = 64


class Encoder:
    """A tokenizer file in use.

    If the file says that white space is dropped after the plain normalizers, a text is
    the row of its words between spaces and line ends. A worker then remembers words,
    and for words of Latin letters the pieces that the file's own pattern cuts them into,
    so that the library's model sees each piece once. Other words, texts that hold the
    file's special tokens, and other files go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_kind(self.tokenizer)
        self.code = "H" if self.kind == "<u2" else "I"
        described = json.loads(self.tokenizer.to_str())
        self.pattern = word_pattern(described)
        if self.pattern:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.table = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}
            self.marks = [t["content"] for t in described["added_tokens"]]
        self.pieces, self.words = Remembered(self._piece), Remembered(self._word)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        found = self.tokenizer.model.tokenize(piece.translate(self.table))
        return pack(f"<{len(found)}{self.code}", *[t.id for t in found])

    def _word(self, word: str) -> bytes:
        if word.isascii() or max(word) < "\u0100":
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word.lower())))
        return self._encode([word])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian."""
        if not self.pattern:
            return self._encode(texts)
        ids = self.words.__getitem__
        out = [
            self._encode([t])[0] if any(m in t for m in self.marks) else b"".join(map(ids, t.replace("\n", " ").split(" ")))
            for t in texts
        ]
        for seen in (self.words, self.pieces):
            if len(seen) > CACHED_WORDS:
                seen.clear()
        return out


class Remembered(dict):
    """What ``find`` gives for each short word, found once."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, word: str) -> bytes:
        ids = self.find(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids


def id_kind(tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def word_pattern(described: dict) -> regex.Pattern | None:
    """The pattern of a file's pieces, if it has one that no white space is part of."""
    steps = (described["normalizer"] or {}).get("normalizers", [])
    cutters = (described["pre_tokenizer"] or {}).get("pretokenizers", [])
    plain = [n for n in steps if n["type"] in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": r"\s+"}]
    lowers = [n["type"] for n in steps].count("Lowercase") == 1
    if not lowers or plain != steps or [c["type"] for c in cutters] != ["Split", "ByteLevel"]:
        return None
    split, level = cutters
    dropped = (split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"])
    pattern = split["pattern"].get("Regex", "").replace(r"\s", r"\t-\r \x85\xa0")  # what counts as space below 256
    if dropped != ("Removed", True, False, False) or not pattern or regex.search(pattern, " ") or any(
        t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in described["added_tokens"]
    ):
        return None
    return regex.compile(pattern)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker: what it remembers serves all its tasks."""
    return Encoder(path)


def _some(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian, with the end id) of every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = encoder(tokenizer)
        end = np.array([end_id], with_.kind).tobytes()
        for batch in batches:
            for part in _some(batch):
                ids = with_.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([i + end for i in ids], pa.binary())], ["doc_id", "ids"]
                )

    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(encode, "doc_id BIGINT, ids BINARY")


def id_counts(tokens: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids in use and how often; no more than the vocabulary holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in _some(batch):
                ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), kind)
                seen = np.bincount(ids, minlength=len(total))
                seen[: len(total)] += total
                total = seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    found = tokens.select("ids").mapInArrow(count, "id BIGINT, n BIGINT")
    rows = found.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def code_lengths(counts: np.ndarray, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits of each symbol: the least total under the limit, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    most_bits = max(most_bits, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    merged, leaf = leaves, [np.ones(n, bool)]
    for _ in range(most_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by_weight = np.argsort(both, kind="stable")
        merged = both[by_weight]
        leaf.append(by_weight < n)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(leaf):
        singles = int(level[:taken].sum())
        lengths[:singles] += 1
        taken = 2 * (taken - singles)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class CodeBook:
    """Canonical codes of ``ids`` with code lengths ``bits``."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        ids, bits = ids[order], bits[order]
        self.most = int(bits[-1]) if len(bits) else 1
        spans = 1 << (self.most - bits)  # entries of the table that start with the code
        first = np.cumsum(spans) - spans
        size = int(ids.max()) + 1 if len(ids) else 0
        self.codes, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.codes[ids], self.bits[ids] = first >> (self.most - bits), bits
        empty = (1 << self.most) - int(spans.sum())
        self.symbols = np.concatenate([np.repeat(ids, spans), np.zeros(empty, np.int64)]).astype(np.uint32)
        self.steps = np.concatenate([np.repeat(bits, spans), np.ones(empty, np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string, and the bit offset of each MARK_IDS-th id."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        word = at >> 5
        shift = (64 - (at & 31) - bits).astype(np.uint64)
        pair = self.codes[ids] << shift  # the code in two words of 32 bits; codes don't overlap, sums are exact
        n = int(ends[-1] >> 5) + 2 if len(ids) else 0
        words = np.bincount(word, (pair >> np.uint64(32)).astype(np.float64), n)
        words += np.bincount(word + 1, (pair & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        length = -(-int(ends[-1]) // 8) if len(ids) else 0
        return words.astype(">u4").tobytes()[:length], at[::MARK_IDS]

    def decode(self, data: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids from the first of ``marks`` on; all marks' runs are decoded side by side."""
        words = np.frombuffer(data + bytes(12 - len(data) % 4), ">u4").astype(np.uint64)
        at = np.asarray(marks, np.int64).copy()
        out = np.empty((len(at), MARK_IDS), np.uint32)
        mask, most = np.uint64((1 << self.most) - 1), 64 - self.most
        for i in range(min(MARK_IDS, n)):
            word = np.minimum(at >> 5, len(words) - 2)  # the last run ends early
            pair = words[word] << np.uint64(32) | words[word + 1]
            entry = (pair >> (most - (at & 31)).astype(np.uint64)) & mask
            out[:, i] = self.symbols[entry]
            at += self.steps[entry]
        return out.reshape(-1)[:n]


BLOCKS = (
    "part INT, block INT, first BIGINT, n INT, bits BINARY, marks ARRAY<INT>, "
    "doc_ids ARRAY<BIGINT>, lengths ARRAY<BIGINT>"
)


def blocks_of(tokens: DataFrame, book: CodeBook, kind: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of each partition of ``tokens``, whose rows are in order."""

    def row(block, first, ids, docs):
        bits, marks = book.encode(ids)
        values = [TaskContext.get().partitionId(), block, first, len(ids), bits, marks, [d for d, _, _ in docs], [n for _, n, _ in docs]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, block, first, end = np.zeros(0, kind), [], 0, 0, 0
        for batch in batches:
            for part in _some(batch):
                coded = part.column("ids").to_pylist()
                for doc_id, data in zip(part.column("doc_id").to_pylist(), coded):
                    n = len(data) // np.dtype(kind).itemsize
                    docs.append((doc_id, n, end))
                    end += n
                ids = np.concatenate([ids, np.frombuffer(b"".join(coded), kind)])
                full = len(ids) // block_ids * block_ids
                for at in range(0, full, block_ids):
                    inside = [d for d in docs if d[2] < first + block_ids]
                    docs = docs[len(inside) :]
                    yield row(block, first, ids[at : at + block_ids], inside)
                    block, first = block + 1, first + block_ids
                ids = ids[full:]
        if len(ids):
            yield row(block, first, ids, docs)

    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return tokens.select("doc_id", "ids").mapInArrow(fill, BLOCKS)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS, most_bits: int = MOST_BITS,
) -> None:
    """Encode doc_id and text of ``docs`` with the tokenizer file and write the folder ``path``."""
    from tokenizers import Tokenizer

    spark, kind = docs.sparkSession, id_kind(Tokenizer.from_file(tokenizer))
    tokens = stage(encoded(docs, tokenizer, end_id), "tokens")
    ids, counts = id_counts(tokens, kind)
    bits = code_lengths(counts, most_bits)
    spark.createDataFrame(
        list(zip(ids.tolist(), bits.tolist())), "id BIGINT, bits INT"
    ).coalesce(1).write.parquet(f"{path}/codes")
    # the place spreads and orders rows that are equal otherwise
    keyed = tokens.select(
        "doc_id", "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("place")
    )
    keys = ["doc_id", "tie", "place"]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    blocks_of(placed, CodeBook(ids, bits), kind, block_ids).write.parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{path}/parts")


def _opened(spark: SparkSession, path: str) -> tuple[CodeBook, DataFrame]:
    rows = spark.read.schema("id BIGINT, bits INT").parquet(f"{path}/codes").collect()
    book = CodeBook(np.array([r.id for r in rows], np.int64), np.array([r.bits for r in rows], np.int64))
    parts = spark.read.schema("part INT, n BIGINT, first BIGINT").parquet(f"{path}/parts")
    starts = parts.select("part", F.col("first").alias("part_first"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(F.broadcast(starts), "part")
    return book, blocks.withColumn("first", F.col("part_first") + F.col("first")).drop("part_first")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit integers) of every document of the files."""
    book, blocks = _opened(spark, path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, ids = [], np.zeros(0, np.uint32)  # documents that began, ids not handed out yet
        for batch in batches:
            for one in _some(batch, 1):
                row = one.to_pylist()[0]
                waiting += zip(row["doc_ids"], row["lengths"])
                ids = np.concatenate([ids, book.decode(row["bits"], row["marks"], row["n"])])
                start = row["first"] + row["n"] - len(ids)
                ends = np.cumsum([n for _, n in waiting])
                whole = int(np.searchsorted(ends, len(ids), side="right"))
                if whole:
                    data = ids[: ends[whole - 1]].astype("<u4").tobytes()
                    starts = [0, *ends[: whole - 1].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([d for d, _ in waiting[:whole]], pa.int64()),
                            pa.array([start + s for s in starts], pa.int64()),
                            pa.array([data[4 * s : 4 * e] for s, e in zip(starts, ends.tolist())], pa.binary()),
                        ],
                        ["doc_id", "start", "ids"],
                    )
                    waiting, ids = waiting[whole:], ids[ends[whole - 1] :]

    in_order = blocks.repartition("part").sortWithinPartitions("part", "block")
    return in_order.mapInArrow(documents, "doc_id BIGINT, start BIGINT, ids BINARY")


def read_range(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """first, ids: the ids from place ``start`` on, a row per block, decoded from the bit offset before."""
    book, blocks = _opened(spark, path)
    wanted = blocks.where((F.col("first") < start + count) & (F.col("first") + F.col("n") > start))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, high = max(0, start - row["first"]), min(row["n"], start + count - row["first"])
                mark = low // MARK_IDS
                marks = row["marks"][mark : -(-high // MARK_IDS)]
                ids = book.decode(row["bits"], marks, high - mark * MARK_IDS)[low - mark * MARK_IDS :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["first"] + low]), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["first", "ids"]
                )

    return wanted.select("first", "n", "bits", "marks").mapInArrow(decode, "first BIGINT, ids ARRAY<BIGINT>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """doc_id, start, ids of ``docs``, written to new token files in the shared folder and read back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, **options)
    return read_documents(docs.sparkSession, path)
