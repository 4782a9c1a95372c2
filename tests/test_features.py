import random
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from lexidom.operators import reference_tables as rt
from lexidom.operators.features import extract_features, pronounceability, word_features
from lexidom.schema import FEATURES_5, FEATURES_6
from tests import brute

WORDS = {"river", "stone", "light", "house", "lamp", "wind"}
GRAMS = {"riv": 0.02, "ive": 0.006, "ver": 0.03, "sto": 0.004, "kkv": 0.0002}

# Invented hosts in order: whole words, parts of words, digits, and noise.
SAMPLE = sorted(
    "brookside7 candlewick dawnharbor fernvale greylantern hillcrest2go ivoryglade jkvzzpt kkvkkvkk "
    "lampstone2 mossbank nettlewood orchardlane pqxw3 quietriver rvrvrvr stonebridge "
    "tidalwind wolfden2019 zephyrcove".split()
)
SAMPLE_WORDS = set("brook side candle wick dawn harbor fern vale lantern hill crest lamp stone bridge river wind den cove".split())
SAMPLE_GRAMS = {
    "bro": 0.013, "roo": 0.007, "ook": 0.021, "can": 0.017, "and": 0.031, "ndl": 0.0015, "sto": 0.019,
    "ton": 0.014, "one": 0.026, "riv": 0.0045, "ive": 0.0085, "ver": 0.0235, "win": 0.0125, "ind": 0.0165,
    "lam": 0.0035, "amp": 0.0055,
}


def vectors(df, columns=FEATURES_6):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ord").collect()]


def assert_close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, rel=1e-10, abs=1e-13)


def test_unit_values(domain_rows, lexicon_of):
    names = ["riverstone", "lampkkvq", "kkvqqq", "river", "ox", ""]
    got = vectors(extract_features(domain_rows(names), lexicon_of(WORDS, GRAMS), levenshtein=False), FEATURES_5)
    by_name = dict(zip(names, got))
    assert by_name["riverstone"][2] == 1.0 and by_name["riverstone"][4] == 0.5
    assert by_name["lampkkvq"][2] == by_name["lampkkvq"][4] == 0.5
    assert by_name["kkvqqq"] == pytest.approx((6, 0, 0, (0.0002 + 3e-10) / 4, 0), rel=1e-9)
    assert by_name["river"][3] == pytest.approx((0.02 + 0.006 + 0.03) / 3)
    assert by_name["ox"][3] == 0.0
    assert by_name[""] == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_cover_is_optimal_not_greedy(domain_rows, lexicon_of):
    rows = domain_rows(["abcab"])
    got = vectors(extract_features(rows, lexicon_of({"abc", "ca", "ab", "bcab"})))
    assert got[0][2] == 1.0


def test_sample_against_the_plain_version(domain_rows, lexicon_of):
    got = vectors(extract_features(domain_rows(SAMPLE), lexicon_of(SAMPLE_WORDS, SAMPLE_GRAMS)))
    assert_close(got, brute.features(SAMPLE, SAMPLE_WORDS, SAMPLE_GRAMS))


def test_rows_without_a_domain_are_kept(spark, lexicon_of):
    rows = spark.createDataFrame([(0, "river"), (1, None), (2, "riven"), (3, None)], "ord BIGINT, domain STRING")
    for levenshtein, columns in ((True, FEATURES_6), (False, FEATURES_5)):
        got = vectors(extract_features(rows, lexicon_of(WORDS, GRAMS), levenshtein=levenshtein), columns)
        assert [g[0] for g in got] == [5.0, None, 5.0, None]
        assert got[1] == got[3] == (None,) * len(columns)
    grams = spark.createDataFrame(sorted(GRAMS.items()), "gram STRING, p DOUBLE")
    got = vectors(pronounceability(rows, grams), ["pronounceability"])
    assert got[1] == got[3] == (None,) and got[0][0] > 0


def test_rows_of_equal_key_stay_apart(spark, lexicon_of):
    rows = spark.createDataFrame([(7, "river"), (7, "river"), (7, "kkv")], "ord BIGINT, domain STRING")
    got = extract_features(rows, lexicon_of(WORDS, GRAMS), levenshtein=False).collect()
    assert sorted(r.pronounceability for r in got) == pytest.approx([0.0002, 0.056 / 3, 0.056 / 3])
    grams = spark.createDataFrame(sorted(GRAMS.items()), "gram STRING, p DOUBLE")
    assert pronounceability(rows, grams).count() == 3


@pytest.mark.parametrize("ords", [[0, 5000, 9000], [1, 2, 3], [0, 1, 1, 2], [0, 1, None], [-1, 0, 1], [0, 1024, 1025]])
def test_positions_that_are_not_dense_are_refused(spark, lexicon_of, ords):
    rows = spark.createDataFrame([(o, f"d{i}") for i, o in enumerate(ords)], "ord BIGINT, domain STRING")
    with pytest.raises(Exception, match="must hold each position"):
        extract_features(rows, lexicon_of(WORDS, GRAMS)).collect()


@pytest.mark.parametrize("partitions", [1, 2, 4, 5, 8])
@pytest.mark.parametrize("chunk_rows", [1, 3, 1024])
def test_same_result_for_any_partitioning(
    domain_rows, lexicon_of, shuffle_partitions, partitions, chunk_rows
):
    shuffle_partitions(partitions)
    rows = domain_rows(SAMPLE).repartition(partitions)
    got = extract_features(rows, lexicon_of(SAMPLE_WORDS, SAMPLE_GRAMS), chunk_rows=chunk_rows)
    assert_close(vectors(got), brute.features(SAMPLE, SAMPLE_WORDS, SAMPLE_GRAMS))


def test_salted_lookup_gives_the_same_rows(domain_rows, lexicon_of):
    lexicon = lexicon_of(SAMPLE_WORDS, SAMPLE_GRAMS)
    assert lexicon.starts_small and lexicon.words_small
    rows = domain_rows(SAMPLE + ["", "zz"])
    for levenshtein in (True, False):
        want = extract_features(rows, lexicon, levenshtein=levenshtein)
        got = extract_features(rows, replace(lexicon, words_small=False, starts_small=False), levenshtein=levenshtein)
        names = FEATURES_6 if levenshtein else FEATURES_5
        assert_close(vectors(got, names), vectors(want, names))


def test_order_by_assigns_positions(domain_rows, lexicon_of):
    rows = domain_rows(SAMPLE[::-1]).drop("ord")
    got = extract_features(rows, lexicon_of(SAMPLE_WORDS, SAMPLE_GRAMS), order_by=["domain"])
    assert_close(vectors(got), brute.features(SAMPLE, SAMPLE_WORDS, SAMPLE_GRAMS))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    domains=st.lists(st.text("ab1é𝒳", max_size=14), min_size=1, max_size=40),
    words=st.sets(st.text("ab1é", min_size=1, max_size=6), max_size=12),
    grams=st.dictionaries(st.text("ab1é", min_size=3, max_size=3), st.floats(1e-6, 1), max_size=20),
)
def test_against_brute_force(domain_rows, lexicon_of, domains, words, grams):
    got = extract_features(domain_rows(domains), lexicon_of(words, grams), chunk_rows=7)
    assert_close(vectors(got), brute.features(domains, words, grams))


def test_long_domain_is_covered_whole(domain_rows, lexicon_of):
    rng = random.Random(7)
    domains = ["".join(rng.choice("abc") for _ in range(253)) for _ in range(5)]
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
    got = vectors(extract_features(domain_rows(domains), lexicon_of(words, {}), levenshtein=False), FEATURES_5)
    assert [g[2] for g in got] == [brute.word_ratio(d, tuple(words)) for d in domains]


def test_single_features_agree_with_all(spark, domain_rows, lexicon_of):
    rows, lexicon = domain_rows(SAMPLE), lexicon_of(SAMPLE_WORDS, SAMPLE_GRAMS)
    full = extract_features(rows, lexicon)
    words = word_features(rows, lexicon)
    pair = ["meaningful_word_ratio", "lms_percentage"]
    assert vectors(words, pair) == vectors(full, pair)
    grams = spark.createDataFrame(sorted(SAMPLE_GRAMS.items()), "gram STRING, p DOUBLE")
    for hint in (True, False):
        single = pronounceability(rows, grams, broadcast=hint)
        assert_close(vectors(single, ["pronounceability"]), vectors(full, ["pronounceability"]))


def test_min_word_len_ignores_single_letters(domain_rows, lexicon_of):
    rows = domain_rows(["xjk29df"])
    letters = set("xjkdf")
    short = vectors(extract_features(rows, lexicon_of(letters)))[0]
    assert short[2] == pytest.approx(5 / 7) and short[4] == pytest.approx(1 / 7)
    assert vectors(extract_features(rows, lexicon_of(letters, min_word_len=2)))[0][2] == 0.0


def test_plan_has_one_shuffle_and_no_python(domain_rows, lexicon_of, tmp_path):
    path = str(tmp_path / "rows")
    domain_rows(SAMPLE).write.parquet(path)
    rows = domain_rows([]).sparkSession.read.parquet(path)
    for levenshtein in (True, False):
        df = extract_features(rows, lexicon_of(SAMPLE_WORDS, SAMPLE_GRAMS), levenshtein=levenshtein)
        plan = df._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("Initial Plan")[-1]
        assert initial.count("Exchange hashpartitioning") == 1
        assert "BroadcastHashJoin" in initial and "SortMergeJoin" not in initial
        assert "Python" not in initial and "Pandas" not in initial


def test_trigram_table_and_leak_free_fit(spark):
    rows = [("mnop", 0, "train"), ("mno", 0, "test"), ("yyyy", 1, "train"), ("mn", 0, "train")]
    df = spark.createDataFrame(rows, "domain STRING, label INT, split STRING")
    every = {r.gram: (r.cnt, r.p) for r in rt.fit_trigrams(df).collect()}
    assert every == {"mno": (2, pytest.approx(2 / 3)), "nop": (1, pytest.approx(1 / 3))}
    train = {r.gram: r.p for r in rt.fit_trigrams(df, "train").collect()}
    assert train == {"mno": 0.5, "nop": 0.5}
    with pytest.raises(ValueError):
        rt.fit_trigrams(df, "test")


def test_dictionaries(spark):
    words = spark.createDataFrame([("Oak",), ("oak",), ("Elm",)], "word STRING")
    assert {r.word for r in rt.dictionary_from_words(words).collect()} == {"oak", "elm"}
    texts = spark.createDataFrame([("elm elm fir Ö",), ("Elm ash",), ("fir",)], "text STRING")
    got = rt.dictionary_from_texts(texts, min_length=2, min_documents=2)
    assert {r.word for r in got.collect()} == {"elm", "fir"}
    assert {r.word for r in rt.dictionary_from_texts(texts).collect()} == {"elm", "fir", "ö", "ash"}
