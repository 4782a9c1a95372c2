"""The training job: read the prepared folder back, build features per split, fit, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..ml import models
from ..operators.evaluation import binary_metrics
from ..operators.features import extract_features
from ..operators.reference_tables import Lexicon, build_lexicon
from ..schema import FEATURES_6, feature_names
from ..session import stage
from ..sources import tables


def read_prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, Lexicon]:
    """Labelled rows with their split, and the lookup tables, as ``preprocess`` wrote them."""
    rows = tables.read_split(spark, f"{folder}/split")
    words = tables.read_words(spark, f"{folder}/english_dictionary")
    return rows, build_lexicon(words, tables.read_trigrams(spark, f"{folder}/trigrams"))


def features_by_split(rows: DataFrame, lexicon: Lexicon, levenshtein: bool = True) -> DataFrame:
    """Features of every row; the predecessor is the one in its own split, in alphabetical order."""
    if levenshtein:
        return extract_features(rows, lexicon, order_by=["domain"], by=["split"])
    return extract_features(rows, lexicon, key="domain", levenshtein=False)


def summary(features: DataFrame, names: list[str] = FEATURES_6) -> DataFrame:
    """Rows and mean features per split and class: what the fit gets to see."""
    return features.groupBy("split", "label").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in names]
    )


def train_and_evaluate(
    spark: SparkSession, folder: str, model_type: str = "rf", levenshtein: bool = True, **options
) -> DataFrame:
    """One row of metrics of a model fitted on the train split and held to the test split."""
    rows, lexicon = read_prepared(spark, folder)
    names = feature_names(levenshtein)
    features = stage(features_by_split(rows, lexicon, levenshtein), "split-features")
    fitted = models.make_model(model_type, names, **options).fit(features.where("split = 'train'"))
    return binary_metrics(models.predict(fitted, features.where("split = 'test'")))
