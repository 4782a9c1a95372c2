"""Model comparisons. Each loops over a few fits on the driver; every fit and every
evaluation is a distributed job. The rows are counted in cells first, for all models of a
comparison at once, so the feature table is read a fixed number of times; a fit's time
is that of growing its trees from the cells. The sweep fits and scores the rows themselves."""

from __future__ import annotations

import time

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evaluation import binary_metrics
from ..operators.ranking import stratified_folds
from ..operators.run_reports import paired_t, score_summary
from ..schema import FEATURES_5, FEATURES_6
from ..session import stage
from .forest import Tally, tallied
from .models import SEED, make_model

METRICS = ["accuracy", "precision", "recall", "f1"]


def _rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    names = [c.split()[0] for c in ddl.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ddl)


def _counted(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[Tally, Tally]:
    rows = [df.select("label", *features, F.lit(own).alias("_own")) for df, own in ((train, True), (test, False))]
    return tallied(rows[0].unionByName(rows[1]), features, [F.col("_own")])[0]


def _fit_and_score(train: Tally, test: Tally, **model) -> dict:
    used = model.get("features", FEATURES_6)
    start = time.perf_counter()
    fitted = make_model(**model).grow(train.of(used))
    seconds = time.perf_counter() - start
    scores = binary_metrics(fitted.tested(test.of(used)), count="n").first().asDict()
    return {**scores, "train_time_sec": seconds}


# Seeds of the parts of a forest lie this far apart.
SEED_STEP = 1_000_003


def hyperparameter_sweep(
    train: DataFrame, test: DataFrame, estimator_values=(50, 100, 200, 300, 500), **options
) -> DataFrame:
    """Forests of several sizes, each holding all trees of the smaller ones.

    Trees of one seed are the same in a smaller and a larger forest, so each size grows
    only the trees it adds. Votes of the parts add up to those of the whole forest;
    ``train_time_sec`` is the time of all trees of that size.
    """
    seed = options.pop("seed", SEED)
    votes = F.array(F.lit(0.0), F.lit(0.0))
    scored, seconds, grown = test.withColumn("_votes", votes), {}, 0
    for n in sorted(set(estimator_values)):
        start = time.perf_counter()
        part = make_model("rf", n_estimators=n - grown, seed=seed + SEED_STEP * len(seconds), **options).fit(train)
        seconds[n] = time.perf_counter() - start + seconds.get(grown, 0.0)
        grown = n
        added = F.zip_with("_votes", vector_to_array("rawPrediction"), lambda x, y: x + y)
        scored = part.transform(scored).withColumn("_votes", added).withColumn(
            f"_class{n}", (F.get("_votes", F.lit(1)) > F.get("_votes", F.lit(0))).cast("int")
        ).drop("features", "rawPrediction", "probability", "prediction")
    sizes = F.inline(F.array(*[
        F.struct(F.lit(n).alias("n_estimators"), F.col(f"_class{n}").alias("prediction")) for n in seconds
    ]))
    metrics = {r.n_estimators: r.asDict() for r in binary_metrics(scored.select("label", sizes), ["n_estimators"]).collect()}
    return _rows(
        train.sparkSession, [{**metrics[n], "train_time_sec": seconds[n]} for n in estimator_values],
        "n_estimators INT, accuracy DOUBLE, f1 DOUBLE, train_time_sec DOUBLE",
    )


def compare_models(train: DataFrame, test: DataFrame, **options) -> DataFrame:
    """Decision tree against random forest, as model, metric, value."""
    rows = []
    train, test = _counted(train, test, options.get("features", FEATURES_6))
    for name, kind in (("decision_tree", "dt"), ("random_forest", "rf")):
        scores = _fit_and_score(train, test, model_type=kind, **options)
        rows += [
            {"model": name, "metric": m, "value": float(scores[m])}
            for m in [*METRICS, "tp", "fp", "fn", "tn", "train_time_sec"]
        ]
    return _rows(train.cells.sparkSession, rows, "model STRING, metric STRING, value DOUBLE")


def feature_ablation(
    train: DataFrame, test: DataFrame, feature_names: list[str] = FEATURES_6, **options
) -> DataFrame:
    """Random forests on the first 1, 2, ... features; a forest sees only those."""
    rows = []
    train, test = _counted(train, test, feature_names)
    for n in range(1, len(feature_names) + 1):
        used = feature_names[:n]
        scores = _fit_and_score(train, test, model_type="rf", features=used, **options)
        rows.append({"n_features": n, "features_used": used, **scores})
    return _rows(
        train.cells.sparkSession, rows,
        "n_features INT, features_used ARRAY<STRING>, accuracy DOUBLE, f1 DOUBLE",
    )


def compare_feature_sets(train: DataFrame, test: DataFrame, **options) -> DataFrame:
    """Six features against five, on one split."""
    rows = []
    train, test = _counted(train, test, FEATURES_6)
    for used in (FEATURES_6, FEATURES_5):
        scores = _fit_and_score(train, test, model_type="rf", features=used, **options)
        rows.append({"config": f"{len(used)}_features", "n_features": len(used), **scores})
    return _rows(
        train.cells.sparkSession, rows,
        "config STRING, n_features INT, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, "
        "f1 DOUBLE, train_time_sec DOUBLE",
    )


def _fold_scores(
    features: DataFrame, models: dict[str, dict], n_splits: int, seed: int, keys: list[str] | None
) -> DataFrame:
    """fold, model, accuracy, f1, fit_time for every model on the same folds."""
    folds = features
    if "fold" in features.columns:
        seen = {r.fold for r in features.select("fold").distinct().limit(n_splits + 1).collect()}
        if seen != set(range(n_splits)):
            raise ValueError(f"fold must hold 0 to {n_splits - 1}")
    else:
        folds = stage(stratified_folds(features, n_splits, keys=keys, seed=seed), "folds")
    used = list(dict.fromkeys(c for model in models.values() for c in model.get("features", FEATURES_6)))
    rows = []
    for i, (train, test) in enumerate(tallied(folds, used, [F.col("fold") != i for i in range(n_splits)])):
        for name, model in models.items():
            scores = _fit_and_score(train, test, **model)
            rows.append({"fold": i, "model": name, "fit_time": scores["train_time_sec"], **scores})
    return _rows(
        features.sparkSession, rows,
        "fold INT, model STRING, accuracy DOUBLE, f1 DOUBLE, fit_time DOUBLE",
    )


def cross_validate(
    features: DataFrame, model_type: str = "rf", n_splits: int = 5, seed: int = 42,
    keys: list[str] | None = None, **options,
) -> DataFrame:
    """Scores per stratified fold; summarize with fold_summary."""
    make_model(model_type)  # reject an unknown type before any job runs
    models = {model_type: {"model_type": model_type, **options}}
    return _fold_scores(features, models, n_splits, seed, keys)


def fold_summary(scores: DataFrame) -> DataFrame:
    return score_summary(scores, ["model"], ["accuracy", "f1"])


def _paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    wide = scores.groupBy("fold").pivot("model", [a, b]).agg(F.first("accuracy"))
    wide = wide.withColumnsRenamed({a: "a", b: "b"})
    by_fold = F.sort_array(F.collect_list(F.struct("fold", "a", "b")))  # a row per fold
    return paired_t(wide, "a", "b").crossJoin(wide.agg(by_fold.alias("fold_scores")))


def paired_models(
    features: DataFrame, n_splits: int = 5, n_estimators: int = 100, seed: int = 42,
    keys: list[str] | None = None, **options,
) -> DataFrame:
    """Paired t-test of random forest (a) against decision tree (b)."""
    models = {
        "rf": {"model_type": "rf", "n_estimators": n_estimators, **options},
        "dt": {"model_type": "dt", **options},
    }
    return _paired(_fold_scores(features, models, n_splits, seed, keys), "rf", "dt")


def paired_feature_sets(
    features: DataFrame, n_splits: int = 5, n_estimators: int = 100, seed: int = 42,
    keys: list[str] | None = None, **options,
) -> DataFrame:
    """Paired t-test of five (a) against six (b) features; the fifth-feature
    form is better only if the gain is positive and significant."""
    forest = {"model_type": "rf", "n_estimators": n_estimators, **options}
    models = {
        "five": {**forest, "features": FEATURES_5},
        "six": {**forest, "features": FEATURES_6},
    }
    test = _paired(_fold_scores(features, models, n_splits, seed, keys), "five", "six")
    better = F.col("significant_at_005") & (F.col("diff_mean") > 0)
    return test.withColumn("five_significantly_better", better)
