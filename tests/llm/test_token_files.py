import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lexidom.llm import queries
from lexidom.llm.token_files import CodeBook, Encoder, code_lengths, read_documents, read_range, write_token_files

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


_loaded = cache(Tokenizer.from_file)


def _ids(path, text):
    return _loaded(path).encode(text or "", add_special_tokens=False).ids


def _read(spark, path):
    rows = read_documents(spark, path).collect()
    return sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows))


def _want(path, docs, end):
    coded = [(i, _ids(path, t) + [end]) for i, t in docs]
    out, at = [], 0
    for i, ids in sorted(coded, key=lambda d: (d[0] is not None, d[0] or 0)):
        out.append((at, i, ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("path,block", [(WORDS, 64), (BYTES, 1000), (WORDS, 65_536)])
def test_documents_come_back(spark, tmp_path, path, block):
    rng = random.Random(block)
    words = ["the", "Cat's", "naïve", "x" * 300, "<|endoftext|>", "a\tb", "　", "𝛼β", "é", "é", "́", "12,5", ""]
    docs = [(i, rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randrange(0, 60)))) for i in rng.sample(range(900), 150)]
    docs += [(-5, None), (None, "no id"), (1000, ""), (1001, " ".join(words * 200))]
    df = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id INT, text STRING, n INT, ids BINARY").repartition(5)
    out = str(tmp_path / "files")
    write_token_files(df, out, path, 7, block_ids=block)
    want = _want(path, docs, 7)
    assert _read(spark, out) == want
    whole = [x for _, _, ids in want for x in ids]
    for start, count in [(0, 1), (len(whole) - 3, 3), (777, 1200), (len(whole), 5), (0, len(whole))]:
        rows = read_range(spark, out, start, count).orderBy("first").collect()
        assert [x for r in rows for x in r.ids] == whole[start : start + count]


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    docs = [(3, "same text"), (3, "other"), (3, "same text"), (1, None), (1, None)]
    for name, rows in (("some", docs), ("none", []), ("one", [(9, None)])):
        df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
        write_token_files(df, str(tmp_path / name), WORDS, 1)
        got = _read(spark, str(tmp_path / name))
        assert sorted((i, ids) for _, i, ids in got) == sorted((i, _ids(WORDS, t) + [1]) for i, t in rows)
        ends = np.cumsum([0, *(len(ids) for _, _, ids in got)]).tolist()
        assert [s for s, _, _ in got] == ends[:-1] and [i for _, i, _ in got] == sorted(i for i, _ in rows)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_words_are_encoded_as_in_the_whole_text(text):
    assert ENCODER.encode([text, text]) == [np.array(_ids(WORDS, text), "<u2").tobytes()] * 2


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=300), max_size=60))
def test_latin_words_are_encoded_as_in_the_whole_text(text):
    assert ENCODER.encode([text]) == [np.array(_ids(WORDS, text), "<u2").tobytes()]


def test_every_low_character_between_others():
    texts = [f"{a}{chr(c)}{b} {chr(c)}" for c in range(400) for a in ("", "A", "1", "'s", ".") for b in ("", "s", "É", "9", "'")]
    assert ENCODER.pattern and not Encoder(BYTES).pattern
    assert [np.frombuffer(x, "<u2").tolist() for x in ENCODER.encode(texts)] == [_ids(WORDS, t) for t in texts]


ENCODER = Encoder(WORDS)


def test_words_of_all_given_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    whole = ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in ENCODER.encode(texts)] == [e.ids for e in whole]


def _least_cost(counts, most_bits):
    """Least total bits by dynamic programming over (symbols placed, open nodes) per level."""
    counts = sorted(counts, reverse=True)
    states = {(0, 1): 0}
    for _ in range(most_bits):
        after = {}
        for (done, open_), cost in states.items():
            cost += sum(counts[done:])
            for leaves in range(min(2 * open_, len(counts) - done) + 1):
                key = (done + leaves, min(2 * open_ - leaves, len(counts)))
                after[key] = min(after.get(key, cost), cost)
        states = after
    return min(c for (done, _), c in states.items() if done == len(counts))


@pytest.mark.parametrize("seed", range(25))
def test_lengths_are_the_cheapest_within_the_limit(seed):
    rng = random.Random(seed)
    n, most = rng.randrange(2, 14), rng.randrange(4, 7)
    counts = np.array([int(rng.choice([1, 5, 3.0**i])) for i in range(n)])
    lengths = code_lengths(counts, most)
    assert lengths.max() <= most and (2.0**-lengths).sum() <= 1
    assert (counts * lengths).sum() == _least_cost(counts.tolist(), most)


@pytest.mark.parametrize("n,symbols,most", [(1, 1, 16), (63, 2, 16), (64, 5, 3), (65, 300, 16), (5000, 70_000, 16), (777, 40, 6)])
def test_codes_decode(n, symbols, most):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) * rng.integers(1, 200, n), symbols) - 1
    used, counts = np.unique(np.concatenate([ids, np.arange(symbols)]), return_counts=True)
    book = CodeBook(used, code_lengths(counts, most))
    data, marks = book.encode(ids)
    assert book.decode(data, marks, n).tolist() == ids.tolist()
    assert book.decode(data, marks[-1:], n - (len(marks) - 1) * 64).tolist() == ids[(len(marks) - 1) * 64 :].tolist()


def test_query_reads_what_the_library_encodes(spark):
    data = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    coded = ENCODER.tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    want, at = [], 0
    for (i, _), e in zip(docs, coded):
        ids = np.array([*e.ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op13_token_files(spark, data).collect()) == want
