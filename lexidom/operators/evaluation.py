"""Classification metrics from (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import zero_safe


def _known(column: str) -> Column:
    """The column; a null fails the job, as the row would be in none of the counts."""
    return F.coalesce(F.col(column).cast("int"), F.raise_error(F.lit(f"{column} must not be null")).cast("int"))


def confusion(predicted: DataFrame) -> DataFrame:
    """label, prediction, cnt for the pairs that occur."""
    return predicted.groupBy(
        F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")
    ).agg(F.count("*").alias("cnt"))


def confusion_matrix(predicted: DataFrame) -> DataFrame:
    """The same as a 2 x 2 matrix, absent pairs as 0; nulls fail the job."""
    label, pred = _known("label"), _known("prediction")
    return predicted.groupBy(label.alias("label")).agg(
        F.count_if(pred == 0).alias("predicted_0"), F.count_if(pred == 1).alias("predicted_1")
    )


def binary_metrics(predicted: DataFrame, by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 in one pass; an empty
    denominator gives 0, a null label or prediction fails the job. ``count`` names
    a column that tells for how many rows each row stands."""
    label, pred = _known("label") == 1, _known("prediction") == 1
    if count is None:
        rows = F.count_if
    else:
        rows = lambda met: F.coalesce(F.sum(F.when(met, F.col(count))), F.lit(0)).cast("bigint")
    counts = predicted.groupBy(*(by or [])).agg(
        rows(label & pred).alias("tp"),
        rows(~label & pred).alias("fp"),
        rows(label & ~pred).alias("fn"),
        rows(~label & ~pred).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *(by or []), "tp", "fp", "fn", "tn",
        zero_safe(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        zero_safe(tp, tp + fp).alias("precision"),
        zero_safe(tp, tp + fn).alias("recall"),
        zero_safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(predicted: DataFrame) -> DataFrame:
    """Per class, macro and support-weighted precision, recall, F1, support;
    the accuracy row repeats the accuracy in all three columns."""
    pairs = F.explode(
        F.array(
            F.struct(F.col("label").cast("int").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
            F.struct(F.col("prediction").cast("int").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")),
        )
    )
    hit = (F.col("label") == F.col("prediction")).cast("int")
    sides = predicted.select(pairs.alias("s"), hit.alias("hit")).select("s.*", "hit")
    rates = (
        sides.groupBy("class")
        .agg(
            F.sum("t").alias("support"), F.sum("p").alias("predicted"),
            F.sum(F.col("t") * F.col("hit")).alias("tp"),
        )
        .select(
            "class", "support", "tp",
            zero_safe(F.col("tp"), F.col("predicted")).alias("precision"),
            zero_safe(F.col("tp"), F.col("support")).alias("recall"),
            zero_safe(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        )
    )
    rate_names = ["precision", "recall", "f1"]
    # From here on there is one row per class.
    line = lambda name, cols: F.struct(
        name.alias("class"), *[c.alias(r) for c, r in zip(cols, rate_names)], F.col("support")
    )
    class_line = line(F.col("class").cast("string"), [F.col(c) for c in rate_names])
    whole = rates.agg(
        F.collect_list(class_line).alias("lines"),
        *[F.avg(c).alias(f"macro_{c}") for c in rate_names],
        *[
            zero_safe(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}")
            for c in rate_names
        ],
        zero_safe(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )
    summary = F.array(
        line(F.lit("accuracy"), [F.col("accuracy")] * 3),
        line(F.lit("macro avg"), [F.col(f"macro_{c}") for c in rate_names]),
        line(F.lit("weighted avg"), [F.col(f"weighted_{c}") for c in rate_names]),
    )
    return whole.select(F.inline(F.concat("lines", summary)))


def class_summary(labelled: DataFrame, split: str = "split") -> DataFrame:
    """Rows, DGA and benign rows and mean length per split, with a Total row."""
    return (
        labelled.rollup(split)
        .agg(
            F.count("*").alias("n"),
            F.sum("label").cast("long").alias("dga"),
            F.count_if(F.col("label") == 0).alias("benign"),
            F.avg(F.length("domain")).alias("avg_length"),
        )
        .withColumn(split, F.coalesce(F.col(split), F.lit("Total")))
    )
