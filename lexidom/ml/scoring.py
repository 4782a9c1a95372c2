"""The scoring model: train or load, score tables, describe itself."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import decode_label, normalized
from ..operators.features import extract_features
from ..operators.reference_tables import Lexicon
from ..schema import FEATURES_5
from ..session import path_exists, stage
from .models import evaluate, predict, random_forest

N_TREES = 50
VERDICT_DDL = (
    "label STRING, probability DOUBLE, p_dga DOUBLE, features STRUCT<"
    + ", ".join(f"{c}: DOUBLE" for c in FEATURES_5) + ">"
)


def load_or_train(
    spark: SparkSession, path: str, train: DataFrame, test: DataFrame, lexicon: Lexicon,
    key: str = "domain", n_estimators: int = N_TREES,
) -> tuple[PipelineModel, DataFrame]:
    """The saved five-feature model and its one-row card, trained if absent.

    ``train`` and ``test`` hold domain and label; ``key`` is unique in each.
    """
    model_path, info_path = f"{path}/model", f"{path}/info"
    if not path_exists(spark, f"{info_path}/_SUCCESS"):
        fit_rows = stage(extract_features(train, lexicon, key, levenshtein=False), "train")
        test_rows = extract_features(test, lexicon, key, levenshtein=False)
        model = random_forest(FEATURES_5, n_estimators).fit(fit_rows)
        accuracy = float(evaluate(model, test_rows)["accuracy"])
        model.write().overwrite().save(model_path)
        card = (
            "ready", f"random forest of {n_estimators} trees", len(FEATURES_5), FEATURES_5,
            fit_rows.count(), accuracy,
        )
        # Written last: a card marks a complete model.
        spark.createDataFrame(
            [card],
            "status STRING, model STRING, n_features INT, feature_names ARRAY<STRING>, "
            "n_training_samples BIGINT, accuracy DOUBLE",
        ).write.mode("overwrite").parquet(info_path)
    return PipelineModel.load(model_path), spark.read.parquet(info_path)


def request_features(requests: DataFrame, lexicon: Lexicon, domain: str = "domain") -> DataFrame:
    """domain, n_requests and the five features per distinct normalized domain.

    Blanks are skipped. Repeated requests fold on the map side before any
    feature is computed, so a domain asked for in a third of all rows costs
    one row.
    """
    asked = (
        requests.select(normalized(F.col(domain)).alias("domain"))
        .where("domain <> ''")
        .groupBy("domain")
        .agg(F.count("*").alias("n_requests"))
    )
    return extract_features(asked, lexicon, key="domain", levenshtein=False)


def score_domains(
    requests: DataFrame, model: PipelineModel, lexicon: Lexicon, domain: str = "domain"
) -> DataFrame:
    """One verdict per distinct normalized domain: domain, n_requests, label,
    probability of that label, p_dga, and the features as a struct."""
    return predict(model, request_features(requests, lexicon, domain)).select(
        "domain",
        "n_requests",
        decode_label(F.col("prediction")).alias("label"),
        "probability",
        "p_dga",
        F.struct(*FEATURES_5).alias("features"),
    )


def score_rows(
    requests: DataFrame, model: PipelineModel, lexicon: Lexicon, domain: str = "domain"
) -> DataFrame:
    """One verdict per request row, with every request column kept.

    The verdicts are staged, so the join back sees their measured size:
    broadcast when small, else a sort-merge join of two plain shuffles, the
    form in which adaptive execution can split a hot domain.
    """
    verdicts = score_domains(requests, model, lexicon, domain).drop("n_requests")
    return join_requests(requests, verdicts, domain)


def join_requests(requests: DataFrame, found: DataFrame, domain: str = "domain") -> DataFrame:
    """Request rows with what was found for their normalized domain; blanks are skipped."""
    found = stage(found, "verdicts")
    rest = [c for c in requests.columns if c != domain]
    rows = requests.withColumn(domain, normalized(F.col(domain))).where(F.col(domain) != "")
    joined = rows.withColumnsRenamed({c: f"_in_{c}" for c in rest}).withColumnRenamed(domain, "domain")
    kept = [F.col(f"_in_{c}").alias(c) for c in rest if c not in found.columns]
    return joined.join(found, "domain").select(*kept, *found.columns)
