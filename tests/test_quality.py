import math

import pytest
from pyspark.sql import functions as F

from lexidom.operators import compare, quality
from lexidom.schema import FEATURES_5, FEATURES_6

GOOD = (11.0, 0.25, 0.4, 0.0125, 0.3, 7.0)


def report(spark, rows, expected=None, columns=FEATURES_6, width=6):
    ddl = "chunk INT, " + ", ".join(f"{c} DOUBLE" for c in columns)
    df = spark.createDataFrame([(0, *r) for r in rows], ddl)
    want = spark.createDataFrame([(0, len(rows) if expected is None else expected)], "chunk INT, expected_rows BIGINT")
    return quality.validation_report(df, expected=want, width=width).first()


@pytest.mark.parametrize(
    "rows, expected, reason",
    [
        ([(4.0, 1.0, 0.0, 0.9, 0.0, 4.0), GOOD, GOOD], 3, None),
        ([GOOD, GOOD], 3, "shape"),
        ([], 4, "shape"),
        ([(11.0, 0.25, math.nan, 0.0125, 0.3, 7.0)], 1, "nan"),
        ([(11.0, 0.25, 0.4, 0.0125, None, 7.0)], 1, "nan"),
        ([(11.0, 0.25, 0.4, 0.0125, 0.3, math.inf)], 1, "inf"),
        ([(-math.inf, 0.25, 0.4, 0.0125, 0.3, 7.0)], 1, "inf"),
        ([(-3.5, 0.25, 0.4, 0.0125, 0.3, 7.0)], 1, "length"),
        ([(11.0, -0.02, 0.4, 0.0125, 0.3, 7.0)], 1, "numerical_ratio"),
        ([(11.0, 0.25, 1.75, 0.0125, 0.3, 7.0)], 1, "meaningful_word_ratio"),
        ([(11.0, 0.25, 0.4, -0.6, 0.3, 7.0)], 1, "pronounceability"),
        ([(11.0, 0.25, 0.4, 0.0125, -0.3, 7.0)], 1, "lms_percentage"),
        ([(11.0, 0.25, 0.4, 0.0125, 0.3, -2.0)], 1, "levenshtein"),
        ([(0.0, 0.0, 1.0, 0.0, 1.0, 0.0)], 1, None),
        ([(9.0, 1 + 5e-10, -5e-10, -5e-10, 1 + 5e-10, -5e-10)], 1, None),
        ([(-3.5, 2.0, 0.0, math.nan, 0.0, 0.0)], 1, "nan"),
    ],
)
def test_rules(spark, rows, expected, reason):
    row = report(spark, rows, expected)
    assert (row.reason, row.valid) == (reason, reason is None)


def test_five_columns_are_the_wrong_shape_unless_asked_for(spark):
    assert report(spark, [GOOD[:5]], columns=FEATURES_5).reason == "shape"
    assert report(spark, [GOOD[:5]], columns=FEATURES_5, width=5).valid


def test_quarantine_splits_and_strict_mode_raises(spark):
    ddl = "ord INT, chunk INT, " + ", ".join(f"{c} DOUBLE" for c in FEATURES_6)
    bad = (11.0, 3.0, 0.4, 0.0125, 0.3, 7.0)
    df = spark.createDataFrame([(0, 0, *GOOD), (1, 0, *GOOD), (2, 1, *GOOD), (3, 1, *bad)], ddl)
    verdicts = quality.validation_report(df)
    valid, failing = quality.split_quarantine(df, verdicts)
    assert sorted(r.ord for r in valid.collect()) == [0, 1]
    assert sorted((r.ord, r.reason) for r in failing.collect()) == [
        (2, "numerical_ratio"), (3, "numerical_ratio")
    ]
    quality.require_valid(verdicts.where("chunk = 0"))
    with pytest.raises(RuntimeError, match=r"1 chunk\(s\) failed validation, first: 1 \(numerical_ratio\)"):
        quality.require_valid(verdicts)


def test_compare_counts_each_kind_of_difference(spark):
    a = [(1, 1.0, 1.0), (2, 2.0, math.nan), (3, 3.0, math.inf), (4, 4.0, math.inf), (5, None, 1.0), (6, 1.0, 1.0)]
    b = [(1, 1.0 + 1e-12, 1.0), (2, 2.5, math.nan), (3, 3.0, math.inf), (4, 4.0, 9.0), (5, None, 1.0), (7, 1.0, 1.0)]
    left = spark.createDataFrame(a, "ord INT, x DOUBLE, y DOUBLE")
    right = spark.createDataFrame(b, "ord INT, x DOUBLE, y DOUBLE")
    got = compare.compare(left, right, "ord", ["x", "y"]).first()
    assert got.asDict() == {
        "n_left": 6, "n_right": 6, "n_unpaired": 2, "n_rows_diff": 2, "diff_x": 1, "diff_y": 2
    }
    assert compare.compare(left, left.where(~F.isnan("y")), "ord", ["x"]).first().n_unpaired == 1


def test_no_row_is_lost_to_chunks_nobody_expected(spark):
    ddl = "ord INT, chunk INT, " + ", ".join(f"{c} DOUBLE" for c in FEATURES_6)
    df = spark.createDataFrame([(0, 0, *GOOD), (1, 9, *GOOD), (2, None, *GOOD), (3, 1, *GOOD)], ddl)
    expected = spark.createDataFrame([(0, 1), (1, 2), (2, 5)], "chunk INT, expected_rows BIGINT")
    verdicts = quality.validation_report(df, expected=expected)
    assert {(r.chunk, r.n_rows, r.reason) for r in verdicts.collect()} == {
        (0, 1, None), (1, 1, "shape"), (2, 0, "shape"), (9, 1, "shape"), (None, 1, "shape")
    }
    valid, failing = quality.split_quarantine(df, verdicts)
    assert [r.ord for r in valid.collect()] == [0]
    assert sorted(r.ord for r in failing.collect()) == [1, 2, 3]
