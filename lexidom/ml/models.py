"""Tree models on feature tables."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.evaluation import binary_metrics
from ..schema import FEATURES_6
from .forest import Forest

# MLlib grows trees level by level over histograms, up to 30 levels. One depth for
# single trees and forests, so that comparisons are of equals; set it per call.
MAX_DEPTH = 10
MAX_BINS = 32
SEED = 42


def _pipeline(classifier, features: list[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), classifier])


def _depth(max_depth: int | None) -> int:
    return MAX_DEPTH if max_depth is None else max_depth


def random_forest(
    features: list[str] = FEATURES_6, n_estimators: int = 100, max_depth: int | None = None,
    seed: int = SEED,
) -> Pipeline:
    return _pipeline(
        RandomForestClassifier(
            numTrees=n_estimators, maxDepth=_depth(max_depth), maxBins=MAX_BINS, seed=seed,
            featureSubsetStrategy="sqrt", cacheNodeIds=True,
        ),
        features,
    )


def decision_tree(
    features: list[str] = FEATURES_6, max_depth: int | None = None, seed: int = SEED
) -> Pipeline:
    return _pipeline(DecisionTreeClassifier(maxDepth=_depth(max_depth), maxBins=MAX_BINS, seed=seed), features)


def make_model(
    model_type: str, features: list[str] = FEATURES_6, n_estimators: int = 100,
    max_depth: int | None = None, seed: int = SEED,
) -> Forest:
    """The models of the comparisons; ``random_forest`` and ``decision_tree`` are MLlib's."""
    if model_type == "rf":
        return Forest(features, n_estimators, _depth(max_depth), seed)
    if model_type == "dt":
        return Forest(features, 1, _depth(max_depth), seed, bootstrap=False)
    raise ValueError(f"Unknown model_type: {model_type}")


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Add prediction, probability (of the predicted class) and p_dga.

    A tie goes to class 0.
    """
    p = vector_to_array("probability")
    scored = model.transform(features).withColumn("_p", p)
    best = F.array_max("_p")
    return (
        scored.withColumn("prediction", (F.array_position("_p", best) - 1).cast("int"))
        .withColumn("probability", best)
        .withColumn("p_dga", F.get("_p", F.lit(1)))
        .drop("_p", "rawPrediction", "features")
    )


def evaluate(model: PipelineModel, test: DataFrame) -> dict[str, float]:
    """Accuracy, precision, recall, F1 and the four confusion counts."""
    return binary_metrics(predict(model, test)).first().asDict()
