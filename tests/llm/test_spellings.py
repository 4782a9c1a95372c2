import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexidom.llm.spellings import group_spellings, near_words, one_apart, rarest_disjoint, roots, signer

from . import brute


def _grouped(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id BIGINT, text STRING, n INT, word STRING")
    rows = group_spellings(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    got = {r.word: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def _variants(rng, word, letters):
    i, x = rng.randrange(len(word)), rng.choice(letters)
    return rng.choice([word, word, word[:i] + word[i + 1 :], word[:i] + x + word[i:], word[:i] + x + word[i + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé÷ßz"])
def test_spellings_are_the_plain_ones(spark, letters):
    rng = random.Random(letters)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(40)]
    docs = []
    for i in range(300):
        some = [_variants(rng, w.upper() if rng.random() < 0.1 else w, letters) for w in rng.choices(words, [1.5**-j for j in range(40)], k=30)]
        docs.append((i, rng.choice([" ", "1", ".", "\n", "_"]).join(some)))
    want = brute.spellings(docs)
    assert _grouped(spark, docs) == want
    assert any(row[0] for row in want.values())


def test_spellings_follow_forms_to_the_root(spark):
    counts = {"abcdefgh": 3000, "abcdefgx": 280, "abcdefyx": 25, "abcdezyx": 2, "apart" * 2: 5}
    docs = [(7, " ".join(w for w, k in counts.items() for _ in range(k)))]
    got = _grouped(spark, docs)
    assert got == brute.spellings(docs)
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)], "word STRING, form STRING")
    assert {r.root for r in roots(chain).collect()} == {"w19"}


def test_spellings_of_odd_texts(spark):
    long_run = "ab" * 30_000
    docs = [(1, None), (None, "sevenxx sevenxx sevenxy sevenxy"), (3, ""), (4, "short words 123"), (4, f"{long_run} {long_run} {long_run[:-1]} {long_run[1:]}x")]
    docs += [(5, f"{long_run[:-1]} aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaaaaa")] * 2
    assert _grouped(spark, docs) == brute.spellings(docs)
    assert _grouped(spark, docs[:1]) == {} == _grouped(spark, [])


def test_near_words_over_all_short_words(spark):
    words = ["".join(w) for k in (3, 4, 5) for w in itertools.product("ab", repeat=k) if k > 3 or w[0] == "a"]
    words = [f"a{w}a" for w in words]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word STRING, n BIGINT")
    got = sorted((r.word, r.near) for r in near_words(df).collect())

    def near(a, b):
        cuts = {b[:i] + b[i + 1 :] for i in range(len(b))}
        return a in cuts or b in {a[:i] + a[i + 1 :] for i in range(len(a))} or (
            len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)

    assert got == sorted((a, b) for a in words for b in words if near(a, b))


@pytest.mark.parametrize("seed", range(50))
def test_pivots_are_the_cheapest_disjoint_bigrams(seed):
    rng = random.Random(seed)
    places, costs = sorted(rng.sample(range(8), 5)), [rng.randrange(9) for _ in range(5)]
    pairs = [(costs[i] + costs[j]) for i in range(5) for j in range(i) if places[i] - places[j] >= 2]
    got = rarest_disjoint(places, costs)
    assert abs(places[got[0]] - places[got[1]]) >= 2 and sum(costs[i] for i in got) == min(pairs)


def test_words_one_apart(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("aé") for _ in range(rng.choice([3, 63, 64, 65, 90])))
        b = _variants(rng, a, "aé")
        pairs.append((a, rng.choice([b, b, _variants(rng, b, "aé")])))
    df = spark.createDataFrame(pairs, "a STRING, b STRING")
    got = df.select("a", "b", one_apart(F.col("a"), F.col("b")).alias("near")).collect()
    assert [r.near for r in got] == [r[0] for r in df.select(F.levenshtein("a", "b") == 1).collect()]
    assert {(len(r.a) > 64, r.near) for r in got} == {(x, y) for x in (True, False) for y in (True, False)}


def test_signature_of_a_word():
    counts = Counter({"ab": 1, "bc": 2, "cd": 3, "de": 9, "ef": 9, "fg": 9})
    assert signer(counts)("abcdefg") == [(0, 0, True), (1, 1, False), (2, 2, True)]
