"""The linguistic features of a table of domains, as one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import UNKNOWN_TRIGRAM_P, char_length, edit_distance, numerical_ratio
from ..schema import feature_names
from ..session import shuffle_partitions
from .ordering import CHUNK_ROWS, assign_ord, assign_ord_within, with_previous
from .reference_tables import Lexicon

# Copies of the lookup table when it is too large to broadcast.
SALTS = 16


def candidate_words(df: DataFrame, domain: str, lexicon: Lexicon) -> DataFrame:
    """The substrings of each domain that can be words, by their beginnings.

    Adds _end (exclusive), _len, gram and p. Each position looks its next
    three characters up once; that gives the trigram's probability and the
    only word lengths worth a second lookup. The probability rides on a row of
    length 0, which positions with a known trigram, and the first one, emit.
    """
    n = F.length(domain)
    none = F.array().cast("array<int>")
    position = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    at = df.withColumn("_start", F.explode(position))
    # Never null, which spares the joins an extra filter on the substring.
    ahead = lambda size: F.coalesce(F.substring(F.col(domain), F.col("_start") + 1, size), F.lit(""))
    starts = lexicon.starts.select(F.col("gram").alias("_three"), "p", "lengths")
    found = at.withColumn("_three", ahead(F.lit(3))).join(
        F.broadcast(starts) if lexicon.starts_small else starts, "_three", "left"
    )
    own = F.when(F.col("p").isNotNull() | (F.col("_start") == 0), F.array(F.lit(0))).otherwise(none)
    short = F.array(*[F.lit(i) for i in lexicon.short_lengths]).cast("array<int>")
    lengths = F.concat(own, short, F.coalesce("lengths", none))
    spans = found.withColumn("_len", F.explode(lengths)).where(F.col("_len") <= F.coalesce(n, F.lit(0)) - F.col("_start"))
    return (
        spans.withColumn("gram", ahead(F.col("_len")))
        .withColumn("_end", F.col("_start") + F.col("_len"))
        .drop("_three", "lengths", "_start")
    )


def find_words(spans: DataFrame, lexicon: Lexicon, salt_key: str) -> DataFrame:
    """Inner lookup of each candidate: broadcast when measured small, else salted.

    Short words occur in almost every domain, so the shuffled form spreads
    each word over several copies of its lookup row.
    """
    if lexicon.words_small:
        return spans.join(F.broadcast(lexicon.words), "gram")
    salted = spans.withColumn("_salt", F.pmod(F.xxhash64(salt_key), F.lit(SALTS)).cast("int"))
    copies = lexicon.words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["gram", "_salt"]).drop("_salt")


def covered_length(hits: Column) -> Column:
    """Most characters that non-overlapping words can cover.

    ``hits`` holds (end, len) structs, taken by end. ``points`` lists the ends
    where the optimum grows, with the optimum there; a word adds its length to
    the optimum of the last point not beyond its start.
    """
    point = lambda end, best: F.struct(end.alias("end"), best.alias("best"))

    def extend(points: Column, hit: Column) -> Column:
        start = hit["end"] - hit["len"]
        before = F.element_at(F.filter(points, lambda q: q["end"] <= start), -1)
        best = before["best"] + hit["len"]
        grows = best > F.element_at(points, -1)["best"]
        return F.when(grows, F.concat(points, F.array(point(hit["end"], best)))).otherwise(points)

    points = F.aggregate(F.sort_array(hits), F.array(point(F.lit(0), F.lit(0))), extend)
    return (
        F.when(F.size(hits) == 0, F.lit(0))
        .when(F.size(hits) == 1, F.get(hits, F.lit(0))["len"])
        .otherwise(F.element_at(points, -1)["best"])
    )


def _lexical(
    rows: DataFrame, lexicon: Lexicon, domain: str, group: list[str], salt_key: str
) -> DataFrame:
    """Word and trigram features of rows that are already grouped by ``group``.

    ``group`` names the unique row key last and starts with the column the
    rows are partitioned by, so exploding, looking up and folding back stay in
    the same stage.
    """
    # Constant within a row's group; as keys they need no aggregation buffer.
    plain = (T.StringType, T.IntegralType)
    others = [f for f in rows.schema.fields if f.name not in group]
    keys = [*group, *[f.name for f in others if isinstance(f.dataType, plain)]]
    carried = [f.name for f in others if f.name not in keys]
    hits = find_words(candidate_words(rows, domain, lexicon), lexicon, salt_key)
    is_word = F.col("_len") > 0
    span = F.struct(F.col("_end").alias("end"), F.col("_len").alias("len"))
    p = F.when(~is_word, F.col("p"))
    folded = hits.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried],
        F.max("_len").alias("_longest"),
        F.collect_list(F.when(is_word, span)).alias("_words"),
        F.sum(p).alias("_p_sum"),
        F.count(p).alias("_p_known"),
    )
    n = F.length(domain)
    grams = n - 2
    unknown = (grams - F.col("_p_known")) * UNKNOWN_TRIGRAM_P
    mean_p = (F.coalesce(F.col("_p_sum"), F.lit(0.0)) + unknown) / grams
    share = lambda chars: F.when(n == 0, F.lit(0.0)).otherwise(chars / n)
    return (
        folded.withColumn("meaningful_word_ratio", share(covered_length(F.col("_words"))))
        .withColumn("pronounceability", F.when(n < 3, F.lit(0.0)).otherwise(mean_p))
        .withColumn("lms_percentage", share(F.col("_longest")))
        .drop("_longest", "_words", "_p_sum", "_p_known")
    )


def extract_features(
    df: DataFrame,
    lexicon: Lexicon,
    key: str = "ord",
    domain: str = "domain",
    levenshtein: bool = True,
    order_by: list[str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    by: list[str] | None = None,
) -> DataFrame:
    """Add the 6 (or, without ``levenshtein``, 5) feature columns to ``df``.

    With ``levenshtein``, ``key`` is the dense position 0 .. n-1 that defines the
    predecessor, or the job fails; ``order_by`` assigns it first. ``by`` names the columns
    of segments, such as a split, that are ordered apart. Without ``levenshtein``, rows of
    equal key stay apart. Either way the table is shuffled once, in its narrow form; the
    substrings never are (unless the lookup table is too large to broadcast).
    Rows whose domain is missing are kept, with null features.
    """
    columns = [c for c in df.columns if c != key] if order_by else df.columns
    rows = df
    if order_by:
        narrow = df.select(*columns)
        rows = assign_ord_within(narrow, by, order_by, key) if by else assign_ord(narrow, order_by, key)
    kept = [*rows.columns]
    if levenshtein:
        rows = with_previous(
            rows, domain, key, "_prev", chunk_rows=chunk_rows, keep_chunk=True, by=by
        )
        group = [*(by or []), "_chunk", key]
    else:
        rows = _numbered(rows.repartition(shuffle_partitions(df.sparkSession), key))
        group = [key, "_row"]
    lexical = _lexical(rows, lexicon, domain, group, key)
    built = {
        "length": char_length(F.col(domain)),
        "numerical_ratio": numerical_ratio(F.col(domain)),
        "levenshtein": edit_distance(F.col(domain), F.col("_prev")) if levenshtein else None,
    }
    features = [
        built[name].alias(name) if built.get(name) is not None else F.col(name)
        for name in feature_names(levenshtein)
    ]
    return lexical.select(*kept, *features)


def _numbered(rows: DataFrame) -> DataFrame:
    """``_row`` tells rows of equal key apart, inside the partition of that key."""
    return rows.withColumn("_row", F.monotonically_increasing_id())


def word_features(df: DataFrame, lexicon: Lexicon, key: str = "ord", domain: str = "domain"):
    """Only the two dictionary features."""
    full = extract_features(df, lexicon, key, domain, levenshtein=False)
    return full.select(*df.columns, "meaningful_word_ratio", "lms_percentage")


def pronounceability(
    df: DataFrame, trigrams: DataFrame, key: str = "ord", domain: str = "domain",
    broadcast: bool = True,
) -> DataFrame:
    """Only the mean trigram probability, as a plain left lookup and average.

    ``broadcast`` is the caller's measured answer for ``trigrams``.
    """
    rows = _numbered(df.repartition(shuffle_partitions(df.sparkSession), key))
    n = F.length(domain)
    grams = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))))
    grams = grams.withColumn("gram", F.substring(F.col(domain), F.col("_i"), F.lit(3)))
    table = trigrams.select("gram", "p")
    found = grams.join(F.broadcast(table) if broadcast else table, "gram", "left")
    carried = [c for c in df.columns if c != key]
    mean_p = F.avg(F.coalesce("p", F.lit(UNKNOWN_TRIGRAM_P)))
    folded = found.groupBy(key, "_row").agg(
        *[F.first(c).alias(c) for c in carried], mean_p.alias("_mean")
    )
    value = F.when(n < 3, F.lit(0.0)).when(n >= 3, F.col("_mean"))
    return folded.select(*df.columns, value.alias("pronounceability"))
