import pytest

from lexidom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "lexidom-tests", memory="6g")
    yield session
    session.stop()


@pytest.fixture
def domain_rows(spark):
    """Build a table of positions and domains from a list."""

    def build(domains, label=None):
        rows = [(i, d, label(d) if label else 0) for i, d in enumerate(domains)]
        return spark.createDataFrame(rows, "ord BIGINT, domain STRING, label INT")

    return build


@pytest.fixture
def lexicon_of(spark):
    from lexidom.operators.reference_tables import build_lexicon

    def build(words=(), grams=None, **options):
        dictionary = spark.createDataFrame([(w,) for w in sorted(words)], "word STRING")
        trigrams = spark.createDataFrame(sorted((grams or {}).items()), "gram STRING, p DOUBLE")
        return build_lexicon(dictionary, trigrams, **options)

    return build


@pytest.fixture
def shuffle_partitions(spark):
    """Set the shuffle width for one test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)
