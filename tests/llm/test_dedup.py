import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexidom.llm import lines as line_dedup, simhash, substrings
from lexidom.llm.lines import dedup_lines
from lexidom.llm.simhash import components, fingerprint, links, near_duplicates
from lexidom.llm.substrings import remove_repeats, rolling

from . import brute

VOCABULARY = [f"w{i}" for i in range(300)]


def _texts(rng, n=60):
    texts = []
    for i in range(n):
        ws = [rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 120))]
        texts.append(" ".join(ws))
        if i % 4 == 0:  # near copies of a long text
            long = [rng.choice(VOCABULARY) for _ in range(400)]
            texts.append(" ".join(long))
            long[rng.randrange(400)] = "changed"
            texts.append("  ".join(long).upper())
    return texts + [None, "", " \n\t", "one", "one two", "one", "É é", "é É"]


@pytest.fixture
def documents(spark):
    def make(texts, **extra):
        rows = [(i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)

    return make


def test_fingerprint_is_the_plain_one():
    for text in _texts(random.Random(1)):
        assert fingerprint((text or "").encode()) == brute.fingerprint(text)


def test_components_are_the_plain_ones(documents):
    texts = _texts(random.Random(2))
    rows = near_duplicates(documents(texts)).collect()
    fps = [brute.fingerprint(t) for t in texts]
    assert {r.doc_id: r.fp % 2**64 for r in rows} == dict(enumerate(fps))
    assert {r.doc_id: r.first.doc_id for r in rows} == dict(enumerate(brute.components(fps)))
    assert len(rows) == len(texts)


def test_links_lose_no_pair(spark, monkeypatch):
    """Dense balls and random points, with a deep tree and deep searches in its leaves."""
    monkeypatch.setattr(simhash, "LEAF_ITEMS", 20)
    monkeypatch.setattr(simhash, "BRUTE_FORCE", 8)
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = [p ^ np.uint64((1 << int(a)) | (1 << int(b))) for p in points[:20] for a, b in rng.integers(0, 64, (20, 2))]
    fps = sorted({int(x) for x in points} | {int(x) for x in flips})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp BIGINT")
    found = components(links(df)).collect()
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    want = brute.components(fps)
    groups = {}
    for i, r in enumerate(want):
        groups.setdefault(r, set()).add(signed[i])
    linked = {frozenset(g) for g in groups.values() if len(g) > 1}
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == linked
    assert all(min(g) == root for root, g in got.items())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a BIGINT, b BIGINT")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_simhash_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert near_duplicates(empty).count() == 0


def test_rolling_hash_is_the_polynomial():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**64, 60, dtype=np.uint64)
    for size in (1, 2, 3, 7, 32, 35, 60):
        got = rolling(words, size, substrings.BASES[0])
        base = substrings.BASES[0]
        want = [
            sum(int(words[i + j]) * pow(base, size - 1 - j, 2**64) for j in range(size)) % 2**64
            for i in range(60 - size + 1)
        ]
        assert got.tolist() == want


def _repeating(rng):
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    texts = []
    for _ in range(30):
        ws = [rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 90))]
        if rng.random() < 0.6:
            a = rng.randrange(0, 30)
            at = rng.randrange(0, len(ws) + 1)
            ws[at:at] = passage[a : a + rng.randrange(5, 60)]
        texts.append(rng.choice([" ", "\n", "  ", "   "]).join(ws))
    return texts + [None, "", "a b c", "a b c", "r " * 80, texts[0], "é " * 9]


@pytest.mark.parametrize("window", [1, 3, 35])
def test_repeats_are_removed_as_by_the_plain_version(documents, window):
    texts = _repeating(random.Random(window))
    rows = {r.doc_id: r for r in remove_repeats(documents(texts), window).collect()}
    for i, (n, kept) in enumerate(brute.substrings(texts, window)):
        assert (rows[i].n_words, rows[i].kept) == (n, " ".join(kept))
        assert sum(s.end - s.start for s in rows[i].spans) == n - len(kept)
        assert all(a.end < b.start for a, b in zip(rows[i].spans, rows[i].spans[1:]))


def test_repeats_of_odd_rows(spark):
    text = " ".join(VOCABULARY[:40])
    rows = [(1, text, 1), (1, text, 2), (None, "x", 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, block INT")
    got = remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=str) == sorted(
        [(1, 40, ""), (1, 40, ""), (None, 1, "x"), (None, 0, "")], key=str
    )
    assert remove_repeats(df.limit(0)).count() == 0


def test_repeats_query_digest(spark, tmp_path):
    from lexidom.llm.queries import op6_substrings

    texts = _repeating(random.Random(9))
    spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    rows = {r.doc_id: r for r in op6_substrings(spark, str(tmp_path)).collect()}
    for i, (n, kept) in enumerate(brute.substrings(texts, 35)):
        digest = hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (n, n - len(kept), digest)


def _lined(rng):
    texts = []
    pool = [[rng.choice(VOCABULARY[:60]) for _ in range(rng.randrange(1, 25))] for _ in range(25)]
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            ws = list(rng.choice(pool))
            if rng.random() < 0.5:
                ws[rng.randrange(len(ws))] = rng.choice(VOCABULARY)
            rng.shuffle(ws)
            lines.append(" ".join(ws))
        texts.append("\n".join(lines))
    return texts + [None, "", "\n\n", "!!!", "!!!", "Of.", "of", "É a", "é, A"]


def test_lines_are_removed_as_by_the_plain_version(documents):
    texts = _lined(random.Random(5))
    rows = {r.doc_id: r for r in dedup_lines(documents(texts)).collect()}
    for i, gone in enumerate(brute.lines_removed(texts)):
        assert list(rows[i].removed) == gone
        left = None if texts[i] is None else [x for j, x in enumerate(texts[i].split("\n")) if j not in gone]
        assert rows[i].text == (None if left is None else "\n".join(left))


def test_long_lines_and_dense_words(documents, monkeypatch):
    """Sets around the bound of the second sketch; near copies settled by their earliest."""
    monkeypatch.setattr(line_dedup, "DENSE", 3)
    rng = random.Random(8)
    texts = []
    for size in (8, 56, 64, 70, 130):
        base = rng.sample(VOCABULARY, size)
        for _ in range(12):
            ws = base[: size - rng.randrange(size // 4)]
            for _ in range(rng.randrange(1 + size // 8)):
                ws[rng.randrange(len(ws))] = rng.choice(VOCABULARY)
            texts.append(" ".join(ws))
    rng.shuffle(texts)
    rows = {r.doc_id: r.removed for r in dedup_lines(documents(texts)).collect()}
    want = [sorted(gone) for gone in brute.lines_removed(texts)]
    assert 10 < sum(map(len, want)) < len(texts) - 5
    assert [rows[i] for i in range(len(texts))] == want


def test_lines_of_odd_rows(spark):
    rows = [(2, "a b c\nnew words here", 1), (None, "a b c", 2), (1, "c b a", 3), (1, "c b a", 3), (1, "other", 4)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, words INT")
    got = dedup_lines(df).select("doc_id", "text", "words").collect()
    assert sorted(map(str, got)) == sorted(
        map(str, spark.createDataFrame(
            [(2, "new words here", 1), (None, "", 2), (1, "c b a", 3), (1, "c b a", 3), (1, "other", 4)], df.schema
        ).collect())
    )
    assert dedup_lines(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies_makes_few_pairs(spark):
    """All but the first of a dense group are settled against one line each."""
    base = [f"k{i}" for i in range(30)]
    rows = [(i, " ".join(base[: i % 30] + [f"u{i}"] + base[i % 30 + 1 :])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = dedup_lines(df).where(F.size("removed") == 0).select("doc_id").collect()
    assert [r.doc_id for r in got] == [0]


def _near_copies(rng):
    """Texts and copies of them with some words changed, around similarity 0.8."""
    texts = []
    for size in (6, 30, 120, 400):
        for _ in range(6):
            base = [rng.choice(VOCABULARY) for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (0, 1, 1, 2, 4, 8):
                ws = list(base)
                for at in rng.sample(range(size), min(changes, size)):
                    ws[at] = rng.choice(VOCABULARY)
                texts.append(" ".join(ws[rng.randrange(1 + size // 20) :]))
    rng.shuffle(texts)
    return texts + [None, "", "!!", "one", "One.", texts[0]]


def test_pipeline_keeps_one_of_each_group_of_near_copies(spark, documents):
    import corpus_pipeline

    texts = _near_copies(random.Random(11))
    sets = [brute.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                root = [root[j] if r == root[i] else r for r in root]
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    kept = corpus_pipeline.near_duplicates(spark, documents(texts), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(first.values())
    assert 24 < len(first) < len(texts) - 30


def _met_words(copies):
    """Texts of which half is one common passage, with a near copy each of a few, and short ones of it alone."""
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(copies):
        own = [f"w{i}x{j}" for j in range(60)]
        texts.append(" ".join(own + passage))
        if i % 10 == 0:
            texts.append(" ".join(own[3:] + passage))
    return texts + [" ".join(passage[i : i + 30]) for i in range(0, 30, 3)]


@pytest.mark.parametrize("dense, spare", [(16, 8), (2, 8), (1, 0), (10**6, 8)])
def test_near_copies_are_the_same_whatever_is_dense(spark, documents, monkeypatch, dense, spare):
    from lexidom.llm import near_copies

    monkeypatch.setattr(near_copies, "DENSE", dense)
    monkeypatch.setattr(near_copies, "SPARE", spare)
    test_pipeline_keeps_one_of_each_group_of_near_copies(spark, documents)
    texts = _met_words(20)
    sets, first = [brute.shingles(x) for x in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                first = [first[j] if r == first[i] else r for r in first]
    kept = near_copies.keep_first_alike(documents(texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(first)) and len(set(first)) < len(texts)


def test_a_passage_of_many_texts_makes_few_pairs(spark, documents, monkeypatch):
    """Texts that only share a passage are met by other shingles; pairs stay in proportion to the texts."""
    from lexidom.llm import near_copies

    asked, edges = [], near_copies._edges
    monkeypatch.setattr(near_copies, "_edges", lambda pairs, *more: asked.append(pairs.count()) or edges(pairs, *more))
    monkeypatch.setattr(near_copies, "SPARE", 60, raising=False)
    monkeypatch.setattr(line_dedup, "RARITY_BUCKETS", 1)  # as in large tables, buckets tell nothing of a single shingle
    texts = [" ".join([f"w{i}x{j}" for j in range(80)] + [f"p{j}" for j in range(120)]) for i in range(60)]
    assert near_copies.keep_first_alike(documents(texts)).count() == len(texts)
    assert sum(asked) <= 4 * len(texts)


def test_near_copies_of_odd_rows(spark):
    from lexidom.llm.near_copies import keep_first_alike

    same = "a b c d e f g"
    rows = [(5, same), (3, "A b, c d e f g"), (None, same), (7, "x y z"), (7, "x y z"), (None, "p q r s"), (9, None), (8, "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id BIGINT, text STRING, cid STRING")
    kept = keep_first_alike(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, "A b, c d e f g"), (7, "x y z"), (None, "p q r s"), (8, "")], key=str
    )
    assert keep_first_alike(df.limit(0)).count() == 0


def test_texts_of_the_same_repeats_are_near_copies(documents):
    """Most of a text is one passage again and again, which its set of shingles does not show."""
    from lexidom.llm.near_copies import keep_first_alike

    passage = " ".join(VOCABULARY[:7]) + " "
    own = [" ".join(f"x{i}y{j}" for j in range(30)) for i in range(4)]
    texts = [own[3], *(passage * 200 + x for x in own[:3]), passage * 2 + own[2]]  # the last has the set of the one before
    assert len({fingerprint(x.encode(), 5) for x in texts[1:4]}) == 1
    kept = keep_first_alike(documents(texts)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1]


def test_fingerprints_that_are_close_by_chance_join_no_texts(documents):
    """A text of two shingles has a bit only where both have it, so it can be next to the wordless one."""
    from lexidom.llm.near_copies import keep_first_alike

    texts = ["", "w63 w57 w84 w40 w95 w96", "w92 w58 w52 w26 w27 w78", "!!"]
    assert [fingerprint(x.encode(), 5).bit_count() for x in texts[:3]] == [0, 2, 2]
    kept = keep_first_alike(documents(texts)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2]
