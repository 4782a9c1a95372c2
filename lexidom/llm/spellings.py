"""Spelling variants of the words of a corpus, by pivotal grams.

Words are counted over all texts. Bigrams are ordered by how many words hold them,
rarest first. A word's prefix is its three rarest bigram places, with up to two more
of the third's bigram; dynamic programming picks from the three the two disjoint ones
(pivots) held by the fewest words in total. One edit spoils at most one of two
disjoint bigrams and moves the others by no more than it changes the length, and it
makes at most two new ones. So of two words at distance one, the one whose third
bigram isn't the commoner has a pivot that stands in the other's prefix, at the same
place or moved by the difference of the lengths. Pivots and prefixes meet in one
equality join on bigram, place, length and the side of the word that the edit spares;
the join's condition compares letter parities, then verifies the distance.

A word's form is its near word of most occurrences, if they are ten times its own or
more; forms of forms are followed by doubling to the root.

Defined cases: null and empty texts hold no words; a null doc_id counts as empty in
the hash; repeated rows count again; texts and words of any length are taken whole;
equal counts go to the word first in code-point order; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
#: One place more than one edit can spoil, and what one edit can put before a place.
PREFIX, MORE = 3, 2


def slipped(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run; where ``every`` divides the hash of document and run, without one letter."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(name.cast("binary"))
    at = (h % F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, without).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = 2) -> DataFrame:
    """word, n: letters in a row of all texts, A-Z in lower case."""
    runs = F.regexp_extract_all(
        F.translate("text", UPPER, LOWER), F.lit(rf"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0)
    )
    return (
        docs.select("doc_id", F.explode(runs).alias("run"))
        .select(slipped(F.col("doc_id"), F.col("run")).alias("word"))
        .where(F.length("word") >= least_length)
        .groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_count)
    )


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Number of words that hold each bigram: at most the square of the 90 letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                seen.update({word[i : i + 2] for i in range(len(word) - 1)})
        yield pa.RecordBatch.from_pydict({"gram": pa.array(seen.keys(), pa.string()), "k": pa.array(seen.values(), pa.int64())})

    found = words.select("word").mapInArrow(count, "gram STRING, k BIGINT")
    return {r.gram: r.k for r in found.groupBy("gram").agg(F.sum("k").alias("k")).collect()}


def rarest_disjoint(places: list[int], costs: list[int], wanted: int = 2) -> list[int]:
    """Which of the bigrams at ascending ``places`` to take: ``wanted`` disjoint ones of least total cost."""
    n = len(places)
    best = [[(0, [])] * (n + 1)]  # best[k][i]: k of the first i
    for _ in range(wanted):
        row = [None]
        for i in range(n):
            apart = sum(p <= places[i] - 2 for p in places[:i])  # those that end before it
            before = best[-1][apart]
            take = before and (before[0] + costs[i], [*before[1], i])
            row.append(min((x for x in (row[-1], take) if x), default=None))
        best.append(row)
    return best[-1][n][1]


def signer(counts: dict[str, int]) -> Callable[[str], list[tuple[int, int, bool]]]:
    """word -> (rank of the bigram, place, whether it is a pivot) of its prefix, rarest first."""
    ranks = {g: i for i, (_, g) in enumerate(sorted((k, g) for g, k in counts.items()))}

    def sign(word: str) -> list[tuple[int, int, bool]]:
        rare = heapq.nsmallest(PREFIX + MORE, ((ranks[word[i : i + 2]], i) for i in range(len(word) - 1)))
        rare = [g for j, g in enumerate(rare) if j < PREFIX or g[0] == rare[PREFIX - 1][0]]
        first = sorted(rare[:PREFIX], key=lambda g: g[1])
        places = [p for _, p in first]
        chosen = {places[i] for i in rarest_disjoint(places, [counts[word[p : p + 2]] for p in places])}
        return [(rank, place, place in chosen) for rank, place in rare]

    return sign


def one_apart(a: Column, b: Column) -> Column:
    """Whether one inserted, deleted or replaced letter tells them apart; in linear time for long words."""
    longer = F.greatest(F.length(a), F.length(b))
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    first = F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)), longer).cast("int")
    # what follows the first difference, in whichever word holds the letter more
    after_a = F.substring(a, F.when(F.length(a) < F.length(b), first).otherwise(first + 1), longer)
    after_b = F.substring(b, F.when(F.length(b) < F.length(a), first).otherwise(first + 1), longer)
    linear = (a != b) & (F.abs(F.length(a) - F.length(b)) <= 1) & (after_a == after_b)
    return F.when(longer <= 64, F.levenshtein(a, b, 1) == 1).otherwise(linear)


def parity(word: str) -> int:
    """63 bits, of which one edit turns two at most."""
    bits = 0
    for letter in word:
        bits ^= 1 << ord(letter) % 63
    return bits


def keys_of(word: str, sign: Callable) -> tuple[int, list[int], list[int]]:
    """Rank of the prefix's last bigram, keys the pivots look for, keys of the prefix.

    A key is a bigram, its place, the word's length and the side that the edit leaves as it is:
    an edit behind the left pivot keeps all up to it, any other edit all from the right one on.
    """
    prefix, length = sign(word), len(word)

    def left(place, length):
        return xxhash.xxh64_intdigest(f"l{length} {word[: place + 2]}") - (1 << 63)

    def right(place, length):
        return xxhash.xxh64_intdigest(f"r{length} {word[place:]}") - (1 << 63)

    first, second = sorted(place for _, place, pivot in prefix if pivot)
    lengths = (length, length + 1, length - 1)
    wanted = [left(first, n) for n in lengths] + [right(second, n) for n in lengths]
    return prefix[-1][0], wanted, [side(place, length) for _, place, _ in prefix for side in (left, right)]


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs one inserted, deleted or replaced letter apart, both ways."""
    sign = signer(gram_counts(words))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("word").to_pylist()
            last, wanted, held = zip(*[keys_of(w, sign) for w in found]) if found else ([], [], [])
            columns = [pa.array(last, pa.int32()), pa.array(map(parity, found), pa.int64()), *(pa.array(k, pa.list_(pa.int64())) for k in (wanted, held))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["word", "n", "last", "parity", "wanted", "held"])

    schema = "word STRING, n BIGINT, last INT, parity BIGINT, wanted ARRAY<BIGINT>, held ARRAY<BIGINT>"
    keyed = stage(words.select("word", "n").mapInArrow(signed, schema), "grams")

    def side(keys, name):
        named = [F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "last", "parity")]
        return keyed.select(F.explode(keys).alias("key"), *named)

    bits = F.bit_count(F.col("a_parity").bitwiseXOR(F.col("b_parity")))
    met = side("wanted", "a").join(side("held", "b"), "key").where(
        (F.col("a_last") <= F.col("b_last")) & (bits <= 2) & one_apart(F.col("a_word"), F.col("b_word"))
    )
    both = F.array(
        F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n")),
    )
    return met.select(F.explode(both).alias("p")).select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): each round joins the links to themselves, which doubles their reach.

    Occurrences grow at least tenfold along a link, so no chain returns or is longer than 19.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stage(
            links.select("word", "root").join(on, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "links",
        )
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def group_spellings(docs: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n over all words of ``docs`` (doc_id, text)."""
    words = stage(vocabulary(docs.select("doc_id", "text")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    about = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    large = -F.col("best.less") >= factor * F.col("n")
    known = stage(
        words.join(about, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    return known.join(roots(known.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
