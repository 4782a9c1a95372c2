import pytest

from lexidom.operators import evaluation


def predictions(spark, matrix):
    """One row per counted pair, built by Spark."""
    df = spark.createDataFrame(
        [(label, p, n) for label, row in enumerate(matrix) for p, n in enumerate(row)],
        "label INT, prediction INT, n INT",
    )
    return df.where("n > 0").selectExpr("label", "prediction", "explode(sequence(1, n)) i").drop("i")


@pytest.mark.parametrize(
    "matrix, accuracy, precision, recall, f1",
    [
        ([[92420, 7566], [7229, 92771]], 0.9260198213874972, 0.9245941178229367, 0.92771, 0.9261494381966386),
        ([[91964, 8022], [8473, 91527]], 0.9175192263458443, 0.9194165687249495, 0.91527, 0.917338598539707),
        ([[5, 0], [3, 0]], 0.625, 0.0, 0.0, 0.0),
        ([[0, 2], [0, 0]], 0.0, 0.0, 0.0, 0.0),
    ],
)
def test_known_metrics(spark, matrix, accuracy, precision, recall, f1):
    got = evaluation.binary_metrics(predictions(spark, matrix)).first()
    assert (got.accuracy, got.precision, got.recall, got.f1) == pytest.approx((accuracy, precision, recall, f1))


def test_confusion_forms(spark):
    df = predictions(spark, [[4, 1], [0, 5]])
    got = {(r.label, r.prediction): r.cnt for r in evaluation.confusion(df).collect()}
    assert got == {(0, 0): 4, (0, 1): 1, (1, 1): 5}
    matrix = {r.label: (r.predicted_0, r.predicted_1) for r in evaluation.confusion_matrix(df).collect()}
    assert matrix == {0: (4, 1), 1: (0, 5)}


def test_no_rows_give_zero_metrics(spark):
    got = evaluation.binary_metrics(spark.createDataFrame([], "label INT, prediction INT")).first()
    assert (got.accuracy, got.f1) == (0.0, 0.0)


def test_report(spark):
    rows = {r["class"]: r for r in evaluation.classification_report(predictions(spark, [[4, 1], [0, 5]])).collect()}
    assert set(rows) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert (rows["0"].precision, rows["0"].recall, rows["0"].support) == (1.0, 0.8, 5)
    assert rows["1"].precision == pytest.approx(5 / 6)
    assert rows["accuracy"].f1 == 0.9 and rows["accuracy"].support == 10
    assert rows["macro avg"].recall == pytest.approx(0.9)
    # A class that is only ever predicted still gets its row.
    lone = evaluation.classification_report(predictions(spark, [[4, 1], [0, 0]])).collect()
    assert {r["class"]: r.support for r in lone}["1"] == 0


def test_summary_has_a_total(spark):
    rows = [("ab", 1, "train"), ("abcd", 0, "train"), ("abc", 0, "test")]
    df = spark.createDataFrame(rows, "domain STRING, label INT, split STRING")
    got = {r.split: (r.n, r.dga, r.benign, r.avg_length) for r in evaluation.class_summary(df).collect()}
    assert got == {"train": (2, 1, 1, 3.0), "test": (1, 0, 1, 3.0), "Total": (3, 1, 2, 3.0)}


@pytest.mark.parametrize("row", ["(null, 1)", "(1, null)"])
@pytest.mark.parametrize("counts", [evaluation.binary_metrics, evaluation.confusion_matrix])
def test_nulls_are_refused(spark, row, counts):
    df = spark.sql(f"select * from values (1, 1), {row} as t(label, prediction)")
    with pytest.raises(Exception, match="must not be null"):
        counts(df).collect()
