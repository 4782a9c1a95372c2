import pytest
from pyspark.sql import functions as F

from lexidom.functions import text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "d STRING").select(fn(F.col("d"))).first()[0]


@pytest.mark.parametrize("value, expected", [("google", 6), ("", 0), ("a" * 100, 100), ("naïve", 5)])
def test_length(spark, value, expected):
    assert one(spark, value, text.char_length) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("google", 0.0), ("12345", 1.0), ("abc123", 0.5), ("", 0.0), ("x²", 0.5), ("٣a", 0.5), ("a①", 0.5), ("½", 0.0)],
)
def test_numerical_ratio(spark, value, expected):
    assert one(spark, value, text.numerical_ratio) == expected


def test_digit_class_agrees_with_isdigit_everywhere(spark):
    points = [cp for cp in range(1, 0x20000) if not 0xD800 <= cp < 0xE000]
    df = spark.createDataFrame([(cp, chr(cp)) for cp in points], "cp INT, c STRING")
    got = {r.cp for r in df.where(text.numerical_ratio(F.col("c")) > 0).collect()}
    want = {cp for cp in points if chr(cp).isdigit()}
    # Newer Unicode decimal digits may be unknown to the JVM.
    assert got <= want and all(chr(cp).isdecimal() for cp in want - got)


@pytest.mark.parametrize(
    "a, b, expected",
    [("google", "google", 0), ("google", "googla", 1), ("abc", "xyz", 3), ("", "", 0), ("abc", "", 3),
     ("", "xyz", 3), ("naïve", "naive", 1)],
)
def test_edit_distance(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a STRING, b STRING")
    assert df.select(text.edit_distance(F.col("a"), F.col("b"))).first()[0] == float(expected)


@pytest.mark.parametrize("value, expected", [("  Foo.COM\t\n", "foo.com"), (" A ", "a"), (" ", "")])
def test_normalized(spark, value, expected):
    assert one(spark, value, text.normalized) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("a.b.co", "a.b.co"), ("https://u:p@a.b.co:80/x?y#z", "a.b.co"), ("a.b.", "a.b"), ("//a.b/c", "a.b"),
     ("a。b", "a.b")],
)
def test_host_of(spark, value, expected):
    assert one(spark, value, text.host_of) == expected


def test_threat_and_label_codes(spark):
    df = spark.createDataFrame([("dga",), ("DGA",), ("other",)], "t STRING")
    coded = df.select(text.encode_threat(F.col("t")).alias("l"))
    assert [r.l for r in coded.collect()] == [1, 0, 0]
    names = coded.select(text.decode_label(F.col("l")).alias("n"))
    assert [r.n for r in names.collect()] == ["DGA", "Benign", "Benign"]
