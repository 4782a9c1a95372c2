import json

import pytest
from pyspark.errors import AnalysisException

from lexidom.sources import raw_log, run_metrics, tables

# Domains that a schema-inferring reader would turn into nulls or numbers.
TRICKY = [("null", 0), ("nan", 1), ("na", 0), ("007", 1), ("1e5", 0), ('q"uote', 1), ("a,b", 0)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_split_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / "split")
    rows = [(d, label, "train" if label else "test") for d, label in TRICKY]
    tables.write_split(spark.createDataFrame(rows, "domain STRING, label INT, split STRING"), path, fmt)
    for split, label in (("train", 1), ("test", 0)):
        got = {tuple(r) for r in tables.read_split(spark, path, split, fmt).collect()}
        assert got == {(d, x) for d, x in TRICKY if x == label}
    assert tables.read_split(spark, path, fmt=fmt).count() == len(TRICKY)


def test_csv_header_must_match(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([(1, "a", "test")], "label INT, domain STRING, split STRING")
    tables.write_split(df, path, "csv")
    with pytest.raises(Exception):
        tables.read_split(spark, path, "test", "csv").collect()


def test_partition_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "split")
    rows = [(d, label, "train" if label else "test") for d, label in TRICKY]
    tables.write_split(spark.createDataFrame(rows, "domain STRING, label INT, split STRING"), path)
    plan = tables.read_split(spark, path, "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_words_round_trip(spark, tmp_path):
    path = str(tmp_path / "words")
    tables.write_words(spark.createDataFrame([("the",), ("bot",)], "word STRING"), path)
    assert {r.word for r in tables.read_words(spark, path).collect()} == {"the", "bot"}
    (tmp_path / "list.txt").write_text("b\n  a \n\n \nb\n")
    got = [r.word for r in tables.read_words(spark, str(tmp_path / "list.txt")).collect()]
    assert sorted(got) == ["a", "b"]


def test_trigrams_round_trip(spark, tmp_path):
    path = str(tmp_path / "grams")
    df = spark.createDataFrame([("abc", 0.25)], "gram STRING, p DOUBLE")
    tables.write_trigrams(df, path)
    assert [tuple(r) for r in tables.read_trigrams(spark, path).collect()] == [("abc", 0.25)]


def test_nested_metrics(spark, tmp_path):
    runs = [{"k": 1, "rep": 0, "time_sec": 2.5, "speedup": 1.0}, {"k": 2, "rep": 0, "time_sec": 1.5}]
    e7 = [{"n_features": 2, "features_used": ["a", "b"], "accuracy": 0.5, "f1": 0.25}]
    e6 = {"random_forest": {"accuracy": 0.9, "confusion_matrix": [[1, 2], [3, 4]]}, "decision_tree": {"f1": 0.5}}
    ipc = {"total_overhead_sec": 0.375, "overhead_percentage": 4.5}
    doc = {
        "system_info": {"OS": "x"}, "sequential_baseline_sec": 31.25, "E1": runs, "E6": e6, "E7": e7,
        "ipc_overhead": ipc, "other": [1],
    }
    path = tmp_path / "metrics.json"
    path.write_text(json.dumps(doc, indent=2))
    got = run_metrics.read_runs(spark, str(path), "E1", multi_line=True)
    assert [(r.k, r.time_sec, r.speedup, r.cpu_util_avg) for r in got.collect()] == [
        (1, 2.5, 1.0, None), (2, 1.5, None, None)
    ]
    used = run_metrics.read_runs(spark, str(path), "E7", multi_line=True).first()
    assert used.features_used == ["a", "b"] and used.n_features == 2
    assert run_metrics.read_runs(spark, str(path), "E8", multi_line=True).count() == 0
    scores = {tuple(r) for r in run_metrics.read_model_scores(spark, str(path)).collect()}
    assert scores == {("random_forest", "accuracy", 0.9), ("decision_tree", "f1", 0.5)}
    overall = run_metrics.read_overall(spark, str(path)).first()
    assert (overall.sequential_baseline_sec, overall.overhead_percentage) == (31.25, 4.5)


def test_runs_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [(k, 125000 * k, rep, k / (rep + 3)) for k in (1, 2) for rep in range(3)]
    df = spark.createDataFrame(rows, "k INT, n INT, rep INT, time_sec DOUBLE")
    run_metrics.write_runs(df, path, "E8")
    assert sorted(tuple(r) for r in run_metrics.read_runs(spark, path, "E8").collect()) == sorted(rows)


@pytest.mark.parametrize(
    "read",
    [raw_log.read_raw_log, tables.read_words, tables.read_trigrams, tables.read_split],
)
def test_missing_source(spark, read):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read(spark, "/no/such/path")


def test_rejected_lines_and_good_rows_add_up(spark, tmp_path):
    lines = ["a,1", "b,x", "c", "d,2,3", '"e,f",0', "g,", ",1", "9999,99999999999"]
    spark.createDataFrame([(x,) for x in lines], "value STRING").write.text(str(tmp_path / "csv"))
    good, rejected = tables.read_rescued(spark, str(tmp_path / "csv"))
    assert sorted((str(r.domain), str(r.label)) for r in good.collect()) == [("None", "1"), ("a", "1"), ("e,f", "0"), ("g", "None")]
    assert sorted(r.line for r in rejected.collect()) == ["9999,99999999999", "b,x", "c", "d,2,3"]


def test_whole_documents_without_a_schema(spark, tmp_path):
    doc = '{"E1": [{"k": 1, "t": 2.5}, {"k": 2, "note": "x"}],\n "E6": {"dt": {"acc": 0.5}, "rf": {"acc": 1}}, "base": 7.25, "E9": [], "none": null}'
    (tmp_path / "m.json").write_text(doc)
    rows = run_metrics.read_documents(spark, str(tmp_path / "m.json"), multi_line=True).collect()
    got = {(r.experiment, r.run, r.field): r.number if r.number is not None else r.text for r in rows}
    assert got == {
        ("E1", "0", "k"): 1.0, ("E1", "0", "t"): 2.5, ("E1", "1", "k"): 2.0, ("E1", "1", "note"): "x",
        ("E6", "dt", "acc"): 0.5, ("E6", "rf", "acc"): 1.0, ("base", None, None): 7.25,
        ("E9", None, None): "[]", ("none", None, None): None,
    }


def test_counted_log_folds_lines_before_the_parse_and_reads_them_once(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = ['{"domain":"A.de","threat":"dga"}'] * 3 + ['  {"domain":"A.de", "threat":"dga"}\t', "# c", "", "{bad"] * 2
    lines += ['{"domain":"A.de","threat":"x"}', '{"domain":"","threat":"dga"}', '{"domain":"b"}']
    df = spark.createDataFrame([(v,) for v in lines], "value STRING")
    raw_log.write_raw_log(df.repartition(3), path)
    counted = raw_log.count_raw_log(spark, path)
    assert sorted(tuple(r) for r in counted.collect()) == [("A.de", "dga", 1, 5), ("A.de", "x", 0, 1)]
    read = raw_log.read_raw_log(spark, path).groupBy("domain", "threat", "label").count()
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, counted.collect()))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.index("from_json") < plan.index("Aggregate [value")
