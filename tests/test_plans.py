"""The registered queries against their SQL, and the whole preparation."""

import duckdb
import pytest

import __spark_entry__ as contract
from lexidom.plans import queries
from lexidom.plans.preprocess import preprocess
from lexidom.sources import raw_log, suffix_rules, tables

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def in_name_order(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    got = in_name_order(df.columns, df.collect())
    result = duck.execute(queries.ORACLES[name])
    want = in_name_order([c[0] for c in result.description], result.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "an empty result checks nothing"


ON_RUNS = ["acceptance", "chunk_sweep", "dataset_scaling", "efficiency_summary", "metrics_document", "run_summary", "scaling_derived"]


@pytest.fixture(scope="module")
def timeless(tmp_path_factory):
    """Tables in which runs of each kind took no time."""
    folder = tmp_path_factory.mktemp("timeless")
    con = duckdb.connect()
    for name in ("events", "documents"):
        con.execute(f"CREATE VIEW given_{name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    value = "* REPLACE (CASE WHEN event_id % 97 = 0 THEN 0 ELSE value END AS value)"
    con.execute(f"COPY (SELECT {value} FROM given_events) TO '{folder}/events.parquet'")
    con.execute(f"COPY (SELECT * FROM given_documents) TO '{folder}/documents.parquet'")
    for name in ("events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ON_RUNS)
def test_runs_of_no_time_match_sql(spark, timeless, name):
    folder, con = timeless
    df = queries.QUERIES[name](spark, folder)
    result = con.execute(queries.ORACLES[name])
    want = in_name_order([c[0] for c in result.description], result.fetchall())
    assert repr(in_name_order(df.columns, df.collect())) == repr(want)  # NaN is no equal of itself
    assert "inf" in repr(want) or "nan" in repr(want)


@pytest.mark.parametrize("name", ["acceptance", "chunk_sweep", "dataset_scaling", "run_summary", "scaling_derived"])
def test_runs_of_negative_zero_time_match_sql(spark, timeless, name, tmp_path):
    _, given = timeless
    value = "* REPLACE (CASE WHEN value = 0 AND event_id % 2 = 1 THEN -value ELSE value END AS value)"
    given.execute(f"COPY (SELECT {value} FROM events) TO '{tmp_path}/events.parquet'")
    given.execute(f"COPY (SELECT * FROM documents) TO '{tmp_path}/documents.parquet'")
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    result = con.execute(queries.ORACLES[name])
    want = in_name_order([c[0] for c in result.description], result.fetchall())
    assert repr(in_name_order(df.columns, df.collect())) == repr(want)


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_preparation_from_a_log(spark, tmp_path):
    rows = [(f'{{"domain":"B{i}.com","threat":"ok"}}',) for i in range(50)]
    rows += [(f'{{"domain":"x{i}q.net","threat":"dga"}}',) for i in range(30)]
    rows += [("# note",), ('{"domain":"b1.org","threat":"dga"}',), ('{"domain":"com","threat":"ok"}',)]
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    raw_log.write_raw_log(spark.createDataFrame(rows, "value STRING").coalesce(1), log)
    words = spark.createDataFrame([("b",)], "word STRING")
    preprocess(spark, log, out, suffix_rules.starter_rules(spark), words, cap=40)
    split = tables.read_split(spark, f"{out}/split", ddl="domain STRING, label INT, ord BIGINT")
    got = [(r.domain, r.label) for r in split.orderBy("ord").collect()]
    want = {(f"b{i}", 0) for i in range(40)} | {(f"x{i}q", 1) for i in range(30)}
    assert got == sorted(want)
    assert split.where("split = 'test'").groupBy("label").count().count() == 2
    grams = {r.gram for r in tables.read_trigrams(spark, f"{out}/trigrams").collect()}
    assert grams == {f"b{i}" for i in range(10, 40)}
    assert [r.word for r in tables.read_words(spark, f"{out}/english_dictionary").collect()] == ["b"]
