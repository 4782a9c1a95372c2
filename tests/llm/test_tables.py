import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexidom.llm import queries
from lexidom.llm.decontaminate import candidates, contained, item_sketches, without_items
from lexidom.llm.mixing import mix
from lexidom.llm.simhash import near_duplicates
from lexidom.llm.topk import SortedLists, search_embeddings

from . import brute

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_are_equal_to_their_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(result.fetchall(), key=repr)
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def _documents(rng, n=80):
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "B", "é", "hot", "hot", "hot", None])
        text = " ".join(rng.choice("xyz") for _ in range(rng.randrange(0, 40)))
        rows.append((i, source, rng.choice([text, text, None])))
    return rows + [(None, "a", "q r"), (None, "a", "s"), (4, "b", "again")]


def test_mix_is_the_plain_one(spark):
    docs = _documents(random.Random(7))
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id BIGINT, source STRING, text STRING, size INT, mix_taken INT")
    got = mix(df).select("doc_id", "source", "text", "mix_size", "mix_source_size", "mix_target", "mix_taken", "size")
    want = [(*d, *m) for d, m in zip(docs, brute.mix(docs))]
    rows = [tuple(r)[:7] for r in got.collect()]
    key = lambda r: repr(r[:5])
    for g, w in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == w[6]


def test_mix_comes_near_its_targets(spark):
    rows = mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg(
        {"mix_taken": "sum", "mix_target": "max", "mix_size": "max"}
    ).collect()
    for r in rows:
        assert -1e-6 <= r["max(mix_target)"] - r["sum(mix_taken)"] <= r["max(mix_size)"]


def test_mix_of_odd_tables(spark):
    schema = "doc_id BIGINT, source STRING, text STRING"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    rows = mix(spark.createDataFrame([(1, None, None), (2, "a", "")], schema)).collect()
    assert [(r.mix_size, r.mix_target, r.mix_taken) for r in rows] == [(0, 0.0, 0)] * 2


def _benchmark(rng):
    vocabulary = [f"v{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 45)))) for i in range(30)]
    docs = []
    for d in range(60):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "edit"
            at = rng.randrange(0, len(ws) + 1)
            ws[at:at] = part
        docs.append((d, ", ".join(ws).upper()))
    return docs + [(90, None), (91, ""), (92, "v1")], items + [(40, None), (41, ""), (42, "v1")]


def test_containment_is_the_plain_one(spark):
    docs, items = _benchmark(random.Random(8))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id BIGINT, text STRING, hash INT")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id BIGINT, text STRING, n_item INT")
    rows = contained(d, i).collect()
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in rows}
    assert got == brute.contained(docs, items) and len(rows) == len(got)
    kept = without_items(d, i)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - {x[0] for x in got}


def test_the_sketches_choose_the_pairs(spark):
    """Far fewer shingles than all are looked for, and a match is always among their pairs."""
    docs, items = _benchmark(random.Random(12))
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    i = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    sketches = item_sketches(i).select(F.struct("item_id", "item1", "item2").alias("item"), "least_shared", "hash", "in_sketch")
    kept = sketches.where("in_sketch").count()
    assert 0 < kept < 0.6 * sketches.count()
    pairs = {(r.doc_id, r.item.item_id) for r in candidates(d, sketches).collect()}
    matches = {x[:2] for x in brute.contained(docs, items)}
    assert matches < pairs and len(pairs) < len(docs) * len(items) / 2


def test_containment_without_a_broadcast(spark, monkeypatch):
    from lexidom.llm import decontaminate

    monkeypatch.setattr(decontaminate, "small", lambda *a: False)
    docs, items = _benchmark(random.Random(11))
    d, i = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in contained(d, i).collect()} == brute.contained(docs, items)


def test_containment_of_odd_tables(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (None, "x"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id BIGINT, text STRING")
    i = spark.createDataFrame([(None, "A, b c d e f"), (None, "A, b c d e f")], "item_id BIGINT, text STRING")
    assert sorted((str(r.doc_id), r.n_shared) for r in contained(d, i).collect()) == [("1", 2), ("None", 2)]
    assert [r.text for r in without_items(d, i).collect()] == ["x"]
    assert contained(d.limit(0), i).count() == contained(d, i.limit(0)).count() == 0
    assert without_items(d, i.limit(0)).count() == 4


def test_top_k_is_the_plain_one(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.choice([0.0, 0.0, 1.0, -1.0, 0.5, 0.25]) for _ in range(4)]) for i in range(0, 900, 3)]
    vectors += [(1, None), (4, [0.1, None, 0.0, 0.0]), (7, [float("nan"), 0.0, 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id BIGINT, embedding ARRAY<FLOAT>, rank INT")
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors[:300]]
    got = [tuple(r) for r in search_embeddings(df).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(brute.top(usable))


def test_top_k_of_odd_tables(spark):
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>"
    assert search_embeddings(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, []), (100, []), (200, [1.0]), (5, [0.0, 0.0]), (5, [0.0, 0.0])]
    got = sorted(tuple(r) for r in search_embeddings(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 5, 0), (0, 3, 5, 0), (100, 1, 2, 0)]


def test_lists_stop_before_their_end():
    """One dimension dominates: the bound falls below the tenth best early."""
    rng = np.random.default_rng(10)
    vectors = rng.integers(-5, 6, (3000, 4))
    vectors[:, 0] = rng.permutation(3000) * 50
    lists = SortedLists(np.arange(3000), vectors)
    seen = []
    lists.doubles = _Watched(lists.doubles, seen)
    rows, scores = lists.top(-1, np.array([9, 1, -1, 0]), 10)
    want = sorted(((-int(v @ [9, 1, -1, 0]), i) for i, v in enumerate(vectors)))[:10]
    assert [(-int(s), int(r)) for r, s in zip(rows, scores)] == want
    assert sum(seen) < 3000


class _Watched:
    def __init__(self, vectors, seen):
        self.vectors, self.seen = vectors, seen

    def __getitem__(self, at):
        if not isinstance(at, tuple) and not isinstance(at, slice):
            self.seen.append(len(at))
        return self.vectors[at]


def test_pipeline_is_its_plain_stages(spark):
    """Each stage against the plain version of its operator, on that stage's own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "decontaminate", "mixing"]

    def go(name, df):
        out = stages[name](spark, df, DATA)
        return out, sorted((r.doc_id, r.text, r.n_chars, r.source) for r in out.collect())

    first, rows = go("language", docs)
    assert rows == sorted((r.doc_id, r.text, r.n_chars, r.source) for r in docs.collect())
    second, cut = go("lines", first)
    gone = brute.lines_removed([r[1] for r in rows])
    for r, c, g in zip(rows, cut, gone, strict=True):
        text = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in g)
        assert c == (r[0], text, len(text), r[3])
    third, kept = go("near_duplicates", second)
    roots = brute.alike_components([c[1] for c in cut])
    assert kept == [c for i, c in enumerate(cut) if roots[i] == i]
    fourth, clean = go("decontaminate", third)
    bad = {x[0] for x in brute.contained([k[:2] for k in kept], items)}
    assert clean == [k for k in kept if k[0] not in bad]
    for df in (first, second, third, fourth):
        assert df.columns == docs.columns
    last = sorted((r.doc_id, r.mix_taken) for r in stages["mixing"](spark, fourth, DATA).collect())
    want = brute.mix([(c[0], c[3], c[1]) for c in clean])
    # texts without words take no part in the sums, and may stay
    assert [x for x in last if x[1]] == sorted((c[0], w[3]) for c, w in zip(clean, want) if w[3])
    ran = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.mix_taken) for r in ran.collect()) == last


def test_pipeline_of_odd_tables(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, fp INT"
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2),
            (2, "some words in a line\nand more", "en", "a", 29, 3), (3, "word " * 30_000, "en", None, 150_000, 4)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, apply in corpus_pipeline.STAGES:
            docs = apply(spark, docs, DATA)
            if name != "mixing":
                assert docs.columns == table.columns
        docs.collect()


def test_near_duplicates_of_the_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    roots = brute.components([brute.fingerprint(t) for _, t in rows])
    got = {r.doc_id: r.first.doc_id for r in near_duplicates(docs).collect()}
    assert got == {d: rows[r][0] for (d, _), r in zip(rows, roots)}
