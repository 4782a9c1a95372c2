import random

import pytest
from pyspark.sql import functions as F

from lexidom.functions.punycode import host_to_unicode
from lexidom.operators import cleaning
from lexidom.sources import suffix_rules
from lexidom.sources.raw_log import fold_lines, parse_lines, read_raw_log

LINES = [
    "# c", "", '{"domain":"Foo.co.uk","threat":"dga"}', "{bad", '{"domain":"","threat":"dga"}',
    '{"domain":"x"}', '{"domain":"bar","threat":"other"}', "[1]",
    '  {"domain":"spaced","threat":"dga"}\t', '{"domain":"cut","threat":"dga"',
    '{"domain":"tail","threat":"dga"} x', "{'domain':'quoted','threat':'dga'}",
    '{"domain":null,"threat":"dga"}', '{"domain":"é.com","threat":"DGA","more":[1,{"a":2}]}',
    '{"threat":"dga","domain":"swapped"}', "   ", '"text"', "{}",
]
KEPT = [("Foo.co.uk", 1), ("bar", 0), ("spaced", 1), ("é.com", 0), ("swapped", 1)]


def test_parse_keeps_only_whole_records(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value STRING")
    got = [(r.domain, r.label) for r in parse_lines(lines).collect()]
    assert sorted(got) == sorted(KEPT)


def test_read_gzip_in_file_order(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(x,) for x in LINES], "value STRING").coalesce(1)
    df.write.option("compression", "gzip").text(path)
    got = [(r.domain, r.label) for r in read_raw_log(spark, path).orderBy("ord").collect()]
    assert got == KEPT


SUFFIX_CASES = {
    "evil-domain.co.uk": "evil-domain", "a.b.co.uk": "a.b", "example.com": "example", "com": "",
    "co.uk": "", "x.uk": "x", "localhost": "localhost", "foo.unknowntld": "foo.unknowntld",
    "foo.bar.ck": "foo", "bar.ck": "", "www.ck": "www", "a.www.ck": "a.www", "ck": "ck",
    "127.0.0.1": "127.0.0.1", "http://u@sub.site.com:80/p.co.uk?q": "sub.site", "site.com.": "site",
    "": "", "x.y.z.de": "x.y.z",
}


def test_strip_suffix(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(SUFFIX_CASES)], "i INT, domain STRING")
    got = cleaning.strip_suffix(df, suffix_rules.starter_rules(spark)).orderBy("i").collect()
    assert {d: r.domain for d, r in zip(SUFFIX_CASES, got)} == SUFFIX_CASES


def test_strip_suffix_never_shuffles_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([("a.com",)], "domain STRING").write.parquet(path)
    df = cleaning.strip_suffix(spark.read.parquet(path), suffix_rules.starter_rules(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_read_suffix_rules_sections(spark, tmp_path):
    path = tmp_path / "list.dat"
    path.write_text(
        "// ===BEGIN ICANN DOMAINS===\n// note\ncom\n*.ck\n!www.ck\n\nCO.uk extra\n// ===END ICANN DOMAINS===\n"
        "// ===BEGIN PRIVATE DOMAINS===\nblogs.com\n// ===END PRIVATE DOMAINS===\n"
    )
    rules = {r.rule: r for r in suffix_rules.read_suffix_rules(spark, str(path)).collect()}
    assert set(rules) == {"com", "ck", "www.ck", "co.uk"}
    assert rules["ck"].wildcard and not rules["ck"].plain and rules["www.ck"].exception
    assert rules["co.uk"].labels == 2
    private = suffix_rules.read_suffix_rules(spark, str(path), private=True)
    assert {r.rule for r in private.collect()} == set(rules) | {"blogs.com"}


def test_dedup_prefers_benign_then_first(spark):
    rows = [("a", 1, 1), ("a", 0, 5), ("a", 0, 3), ("b", 1, 9), ("b", 1, 2), ("c", 0, 0)]
    df = spark.createDataFrame(rows, "domain STRING, label INT, ord BIGINT")
    got = {(r.domain, r.label, r.ord) for r in cleaning.dedup_benign_wins(df, "ord").collect()}
    assert got == {("a", 0, 3), ("b", 1, 2), ("c", 0, 0)}
    assert {(r.domain, r.label) for r in cleaning.dedup_benign_wins(df).collect()} == {
        ("a", 0), ("b", 1), ("c", 0)
    }


def test_clean_runs_all_steps_in_order(spark):
    rows = [("A.com", 1), ("a.co.uk", 0), ("com", 0), ("b.net", 1), ("a", 1)]
    df = spark.createDataFrame(rows, "domain STRING, label INT")
    got = {(r.domain, r.label) for r in cleaning.clean(df, suffix_rules.starter_rules(spark)).collect()}
    assert got == {("a", 0), ("b", 1)}


def test_merge_classes_keeps_source_rank(spark):
    one = spark.createDataFrame([("a", 0)], "domain STRING, label INT")
    two = spark.createDataFrame([("a", 1)], "domain STRING, label INT")
    got = {(r.domain, r.label, r.source_rank) for r in cleaning.merge_classes(one, two).collect()}
    assert got == {("a", 0, 0), ("a", 1, 1)}


@pytest.mark.parametrize("private", [True, False])
def test_missing_rule_file(spark, private):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        suffix_rules.read_suffix_rules(spark, "/no/such/list", private)


def test_log_order_is_file_order(spark, tmp_path):
    """Files of unequal size, which Spark packs into tasks by size."""
    want = []
    for name, lines in (("a", 3), ("b", 50), ("c", 10), ("d", 400)):
        rows = [f"{name}{i}" for i in range(lines)]
        want += rows
        text = "".join(f'{{"domain":"{r}","threat":"dga"}}\n' for r in rows)
        (tmp_path / f"{name}.json").write_text(text)
    got = read_raw_log(spark, str(tmp_path)).orderBy("ord").select("domain").collect()
    assert [r.domain for r in got] == want
    capped = cleaning.cap_per_class(read_raw_log(spark, str(tmp_path)), 5).orderBy("ord").collect()
    assert [r.domain for r in capped] == want[:5]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = read_raw_log(spark, str(tmp_path)).orderBy("ord").select("domain").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.domain for r in got] == want


def test_coded_labels_are_decoded(spark):
    rng = random.Random(4)
    letters = "abz-09" + "éüßœΩжя中国港日本語한𐍈😀"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 20))).strip("-") or "é" for _ in range(400)}
    coded = [("xn--" + w.encode("punycode").decode(), w) for w in sorted(words) if not w.isascii()]
    bad = ["xn--", "xn--99999999", "xn--a_b", "xn--é", "plain", "xn--zz!!", "xn--0000000000000000000000000000000000", "", "xn--b-z"]
    df = spark.createDataFrame([*coded, *[(b, b) for b in bad]], "host STRING, want STRING")
    got = df.select("host", "want", host_to_unicode(F.col("host")).alias("got")).collect()
    assert [(r.host, r.got) for r in got if r.got != r.want] == []
    both = spark.createDataFrame([("a.xn--bcher-kva.XN--FIQS8S",)], "host STRING")
    assert both.select(host_to_unicode(F.col("host"))).first()[0] == "a.bücher.中国"


def test_suffixes_meet_in_either_spelling(spark):
    rules = suffix_rules.rules_from(spark, ["рф", "xn--fiqs8s", "com", "com.xn--fiqs8s"])
    hosts = ["a.b.рф", "a.xn--p1ai", "x.com.中国", "x.com.xn--fiqs8s", "xn--n3h.com", "xn--p1ai", "y.org"]
    df = spark.createDataFrame([(h,) for h in hosts], "domain STRING")
    got = [r.domain for r in cleaning.strip_suffix(df, rules, idna=True).collect()]
    assert got == ["a.b", "a", "x", "x", "xn--n3h", "", "y.org"]


def test_repeats_fold_before_lines_are_parsed_and_suffixes_looked_up(spark):
    line = '{"domain":"%s","threat":"%s"}'
    rows = [(line % ("B.com", "dga"), 1), (line % ("b.com", "ok"), 5), (line % ("b.net", "ok"), 3)] * 40
    rows += [(line % ("b.net", "ok"), 4), ("# note", 0), (line % ("x.com", "dga"), 9), (line % ("x.com", "dga"), 7)]
    folded = fold_lines(spark.createDataFrame(rows, "value STRING, doc_id BIGINT"), "doc_id")
    assert folded.count() == 5
    out = cleaning.clean(parse_lines(folded), suffix_rules.starter_rules(spark), "doc_id")
    assert sorted(tuple(r) for r in out.select("domain", "label", "doc_id").collect()) == [("b", 0, 3), ("x", 1, 7)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Join LeftOuter"):]
    assert "Aggregate [domain#" in below  # of domains that still have their suffix
