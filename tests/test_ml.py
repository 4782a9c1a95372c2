import hashlib
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexidom.ml import experiments, forest, models, scoring
from lexidom.operators.features import extract_features
from lexidom.operators.ranking import stratified_folds, stratified_split
from lexidom.operators.reference_tables import build_lexicon, fit_trigrams
from lexidom.schema import FEATURES_5, FEATURES_6
from lexidom.session import stage
from lexidom.streaming import scoring as streaming
from lexidom.streaming.scoring import read_batches, read_requests, score_stream

SYLLABLES = "ba be bi bo da de do fa fi ga go ka ke ki la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te ti to".split()


@pytest.fixture(scope="module")
def world(spark):
    """Labelled domains with a dictionary that knows some of their words."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 3))) for _ in range(300)})
    benign = {rng.choice(words) + rng.choice(words) for _ in range(500)}
    dga = {hashlib.md5(d.encode()).hexdigest()[: len(d)] for d in benign}
    rows = [(d, 0) for d in sorted(benign)] + [(d, 1) for d in sorted(dga - benign)]
    labelled = stage(spark.createDataFrame(rows, "domain STRING, label INT"))
    dictionary = spark.createDataFrame([(w,) for w in words[::2]], "word STRING")
    lexicon = build_lexicon(dictionary, fit_trigrams(labelled))
    features = stage(extract_features(labelled, lexicon, order_by=["domain"]))
    split = stage(stratified_split(features))
    return lexicon, labelled, features, split.where("split = 'train'"), split.where("split = 'test'")


def test_models_reach_the_accuracy_band(world):
    _, _, _, train, test = world
    for kind in ("rf", "dt"):
        scores = models.evaluate(models.make_model(kind, n_estimators=20).fit(train), test)
        assert scores["accuracy"] > 0.93, kind


def test_unknown_model_type(world):
    with pytest.raises(ValueError, match="Unknown model_type: svm"):
        models.make_model("svm")
    with pytest.raises(ValueError, match="Unknown model_type"):
        experiments.cross_validate(world[2], "svm")


def test_probability_is_of_the_predicted_class_and_ties_are_benign(spark):
    class Fixed:
        def transform(self, df):
            return df

    rows = [(Vectors.dense([0.3, 0.7]), 0.0), (Vectors.dense([0.5, 0.5]), 1.0), (Vectors.dense([0.9, 0.1]), 0.0)]
    df = spark.createDataFrame(rows, ["probability", "prediction"]).withColumn("i", F.monotonically_increasing_id())
    got = [(r.prediction, r.probability, r.p_dga) for r in models.predict(Fixed(), df).orderBy("i").collect()]
    assert got == [(1, 0.7, 0.7), (0, 0.5, 0.5), (0, 0.9, 0.1)]


def test_experiments_have_their_rows(world):
    _, _, _, train, test = world
    options = {"max_depth": 4}
    sweep = experiments.hyperparameter_sweep(train, test, (2, 4), **options).collect()
    assert [r.n_estimators for r in sweep] == [2, 4] and all(r.accuracy > 0.8 for r in sweep)
    versus = experiments.compare_models(train, test, n_estimators=3, **options).collect()
    assert {r.model for r in versus} == {"decision_tree", "random_forest"} and len(versus) == 18
    ablation = experiments.feature_ablation(train, test, n_estimators=3, **options).collect()
    assert [r.features_used for r in ablation] == [FEATURES_6[:n] for n in range(1, 7)]
    sets = experiments.compare_feature_sets(train, test, n_estimators=3, **options).collect()
    assert [(r.config, r.n_features) for r in sets] == [("6_features", 6), ("5_features", 5)]


def test_cross_validation_and_paired_tests(world):
    _, _, features, _, _ = world
    folds = stage(stratified_folds(features, 3))
    scores = experiments.cross_validate(folds, "dt", 3, max_depth=3)
    assert sorted(r.fold for r in scores.collect()) == [0, 1, 2]
    summary = experiments.fold_summary(scores).first()
    assert 0.8 < summary.accuracy_mean <= 1 and summary.accuracy_std >= 0
    paired = experiments.paired_models(folds, 3, n_estimators=3, max_depth=3).first()
    assert paired.n == 3 and abs(paired.mean_a - paired.mean_b - paired.diff_mean) < 1e-12
    sets = experiments.paired_feature_sets(folds, 3, n_estimators=3, max_depth=3).first()
    assert sets.n == 3 and sets.five_significantly_better in (True, False)


@pytest.fixture(scope="module")
def served(spark, world, tmp_path_factory):
    lexicon, labelled, _, _, _ = world
    split = stage(stratified_split(labelled))
    path = str(tmp_path_factory.mktemp("model"))
    parts = [split.where(F.col("split") == s) for s in ("train", "test")]
    return path, parts, *scoring.load_or_train(spark, path, *parts, lexicon, n_estimators=10)


def test_card_and_reload(spark, world, served):
    path, parts, model, card = served
    row = card.first()
    assert row.feature_names == FEATURES_5 and row.n_features == 5
    assert row.n_training_samples == parts[0].count() and row.accuracy > 0.9
    again, card_again = scoring.load_or_train(spark, path, None, None, world[0])
    assert card_again.first() == row and again.stages[-1].uid == model.stages[-1].uid


def test_verdicts(spark, world, served):
    lexicon, model = world[0], served[2]
    asked = [("Bado ", 1), ("bado", 2), ("  ", 3), ("", 4), ("8f3a9c0e1d77", 5), ("bado", 6), (None, 7)]
    df = spark.createDataFrame(asked, "domain STRING, id INT")
    per_domain = {r.domain: r for r in scoring.score_domains(df, model, lexicon).collect()}
    assert {d: r.n_requests for d, r in per_domain.items()} == {"bado": 3, "8f3a9c0e1d77": 1}
    assert per_domain["8f3a9c0e1d77"].label == "DGA" and per_domain["bado"].label == "Benign"
    for r in per_domain.values():
        assert r.probability >= 0.5 and r.features.length == len(r.domain)
        assert r.probability == pytest.approx(r.p_dga if r.label == "DGA" else 1 - r.p_dga)
    rows = scoring.score_rows(df, model, lexicon).collect()
    assert sorted(r.id for r in rows) == [1, 2, 5, 6]


DDL = "domain STRING, id INT"


def _source(spark, labelled, path):
    """Three files; each domain is asked for by several requests."""
    ids = F.explode(F.array(F.lit(1), F.lit(2))).alias("id")
    rows = labelled.select("domain", ids).unionByName(spark.createDataFrame([(" ", 3), (None, 4)], DDL))
    rows.repartition(3, "id", "domain").write.parquet(path)
    return rows


def test_stream_gives_a_verdict_per_request(spark, world, served, tmp_path):
    lexicon, labelled, model = world[0], world[1], served[2]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = _source(spark, labelled, source)
    stream = read_requests(spark, source, DDL, max_files=1)
    read = lambda: read_batches(spark, out, f"id INT, domain STRING, {scoring.VERDICT_DDL}")
    assert read().count() == 0
    score_stream(stream, model, lexicon, out, state).awaitTermination()
    assert spark.read.parquet(f"{out}/manifest/batch=*").count() == 3
    # Means may differ in the last bit: sums meet in any order.
    exact = [F.round(f"features.{c}", 12).alias(c) for c in FEATURES_5]
    columns = ["id", "domain", "label", F.round("probability", 9).alias("probability"), *exact]
    batch = scoring.score_rows(rows, model, lexicon).select(*columns)
    assert sorted(read().select(*columns).collect()) == sorted(batch.collect())
    # New files are picked up from where the stream stopped.
    spark.createDataFrame([("bado", 9)], DDL).write.mode("append").parquet(source)
    before = read().count()
    score_stream(stream, model, lexicon, out, state).awaitTermination()
    assert read().count() == before + 1


def test_a_batch_that_breaks_before_its_commit_is_written_once(spark, world, tmp_path, monkeypatch):
    lexicon, labelled = world[0], world[1]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = _source(spark, labelled, source)
    stream = read_requests(spark, source, DDL, max_files=1)
    names = ", ".join(f"{c} DOUBLE" for c in FEATURES_5)
    ids = lambda: sorted((r.id, r.domain) for r in read_batches(spark, out, f"id INT, domain STRING, {names}").collect())

    def broken(spark, line, batch_id, folder):
        if batch_id == 1:
            raise RuntimeError("lost between rows and manifest")
        commit(spark, line, batch_id, folder)

    commit = streaming.commit
    monkeypatch.setattr(streaming, "commit", broken)
    with pytest.raises(Exception, match="lost between"):
        streaming.feature_stream(stream, lexicon, out, state).awaitTermination()
    first = ids()
    want = sorted((r.id, r.domain) for r in rows.collect() if (r.domain or "").strip())
    assert 0 < len(first) < len(want)  # rows of the broken batch lie there, unread
    monkeypatch.setattr(streaming, "commit", commit)
    streaming.feature_stream(stream, lexicon, out, state).awaitTermination()
    assert ids() == want
    # a replay of a committed batch changes nothing
    streaming.feature_stream(stream, lexicon, out, str(tmp_path / "again")).awaitTermination()
    assert ids() == want


def test_sweep_grows_each_tree_once_and_adds_the_votes(world, monkeypatch):
    _, _, _, train, test = world
    parts = []

    class Kept:
        def __init__(self, kind, n_estimators, **options):
            self.pipeline, self.n = models.make_model(kind, n_estimators=n_estimators, **options), n_estimators

        def fit(self, rows):
            parts.append((self.n, self.pipeline.fit(rows)))
            return parts[-1][1]

    monkeypatch.setattr(experiments, "make_model", lambda kind, **options: Kept(kind, **options))
    rows = experiments.hyperparameter_sweep(train, test, (5, 2, 3), max_depth=4).collect()
    assert [r.n_estimators for r in rows] == [5, 2, 3]
    assert [n for n, _ in parts] == [2, 1, 2]  # five trees, not ten
    votes, right = {}, {}
    for size, (_, model) in zip((2, 3, 5), parts):
        for r in model.transform(test).select("domain", "label", "rawPrediction").collect():
            v = votes.get(r.domain, (0.0, 0.0))
            votes[r.domain] = (v[0] + r.rawPrediction[0], v[1] + r.rawPrediction[1])
            right[size] = right.get(size, 0) + ((votes[r.domain][1] > votes[r.domain][0]) == r.label)
    assert {r.n_estimators: r.accuracy for r in rows} == pytest.approx({n: c / len(votes) for n, c in right.items()})


def test_forest_work_follows_cells_and_draws_follow_the_data(world):
    """A hundredfold of the same rows has the same cells; partitions change no tree."""
    _, _, _, train, _ = world
    limits = forest._limits(train, FEATURES_6)
    many = train.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100))))
    cells = {r.cell: r.n for r in forest._cells(train, FEATURES_6, limits).collect()}
    assert {r.cell: r.n for r in forest._cells(many, FEATURES_6, limits).collect()} == {c: 100 * n for c, n in cells.items()}
    assert sum(cells.values()) == train.count()
    grown = [models.make_model("rf", n_estimators=4).fit(rows) for rows in (train.coalesce(1), train.repartition(7))]
    if all((a == b).all() for a, b in zip(grown[0].limits, grown[1].limits)):
        for a, b in zip(*(m.trees for m in grown)):
            assert a.left.tolist() == b.left.tolist() and a.cut.tolist() == b.cut.tolist()


def test_poisson_draws_have_their_mean_and_spread():
    n = np.repeat([1, 2, 40, 5000, 3_000_000], 40_000)
    draws = forest.poisson(n)(forest._uniform(np.arange(len(n)), 7)).reshape(5, -1)
    mean = n.reshape(5, -1)[:, 0]
    assert draws.min() >= 0
    assert np.abs(draws.mean(1) - mean).max() < 5 * np.sqrt(3_000_000 / 40_000)
    assert draws.mean(1) == pytest.approx(mean, rel=0.03) and draws.var(1) == pytest.approx(mean, rel=0.05)
    assert (draws[0] == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_plain_tree_takes_the_best_split_and_null_features_fail(spark):
    rows = [(float(i), float(i % 3), int(i >= 6)) for i in range(10)]
    table = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, label INT")
    model = models.make_model("dt", ["b", "a"]).fit(table)
    (tree,) = model.trees
    assert tree.left.tolist() == [1, 1, 2] and model.features[tree.feature[0]] == "a"
    assert model.limits[1][tree.cut[0]] == 5.0 and tree.share.tolist() == [0.4, 0.0, 1.0]
    assert all(r.prediction == r.label for r in model.transform(table).collect())
    with pytest.raises(Exception, match="null or NaN feature"):
        models.make_model("dt", ["a"]).fit(table.withColumn("a", F.when(F.col("a") > 1, F.col("a"))))


def test_comparisons_read_the_rows_a_fixed_number_of_times(spark, world):
    """Cells give the scores that fits on the rows give, and more folds or models read no more rows."""
    _, _, features, _, _ = world
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x

    def reads(n_splits, run):
        folds = stage(stratified_folds(features, n_splits)).withColumn("length", seen("length"))
        before = read.value
        rows = run(folds, n_splits, max_depth=4).collect()
        return (read.value - before) / features.count(), rows

    few, scores = reads(3, lambda *a, **o: experiments.cross_validate(a[0], "rf", a[1], n_estimators=3, **o))
    more, _ = reads(5, lambda *a, **o: experiments.paired_feature_sets(*a, n_estimators=3, **o))
    assert few == more <= 3
    folds = stage(stratified_folds(features, 3))
    for r in scores:
        fitted = models.make_model("rf", n_estimators=3, max_depth=4).fit(folds.where(F.col("fold") != r.fold))
        plain = models.evaluate(fitted, folds.where(F.col("fold") == r.fold))
        assert (r.accuracy, r.f1) == pytest.approx((plain["accuracy"], plain["f1"]), abs=0.02)


def test_a_tally_of_some_features_counts_the_same_rows(world):
    _, _, features, _, _ = world
    used = [FEATURES_6[4], FEATURES_6[1]]
    ((own, other),) = forest.tallied(features, FEATURES_6, [F.col("label") == 1])
    assert other.cells.where("cell & 1 = 1").isEmpty() and own.cells.where("cell & 1 = 0").isEmpty()
    cells = {r.cell: r.n for r in own.of(used).cells.collect()}
    limits = [own.limits[4], own.limits[1]]
    assert cells == {r.cell: r.n for r in forest._cells(features.where("label = 1"), used, limits).collect()}
    with pytest.raises(ValueError, match="other features"):
        models.make_model("rf", used).grow(own)
