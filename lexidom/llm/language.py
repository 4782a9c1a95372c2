"""Language identification with interpolated Kneser-Ney character models.

Counts of all character 4-grams of the labelled training texts are summed in
Spark; lower orders follow from their types. A model keeps, per order, sorted
arrays of n-grams (21 bits a letter, so that all letters stay apart) with log
probabilities, and of contexts with the log of the mass left to the next lower
order. A text gets the language of the lowest cross-entropy per character. It is
rejected if that lies further above the language's leave-one-out mean over the
training text than the sampling error of its length and a fixed slack allow.

Models too large to be gathered are tables instead, joined with the different
4-grams of the texts: the same orders, probabilities and labels at any size.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is
rejected; ties go to the smallest label; without training rows every text is
``und``; a null doc_id is predicted but not learned from; repeated rows are each
counted and returned; a very long text is scored whole; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import small, text_key

ORDER = 4
FOLDS = 5
#: Characters scored at a time, so that memory doesn't depend on the size of a batch.
PART = 1_000_000
#: Models are gathered only below this; beyond it they are joined as tables.
MODEL_BYTES = 192 << 20
#: Bits of a letter in a packed n-gram: three letters fill 63.
BITS = 21
#: Sampling errors, and the slack in nats per character, beyond which a text is rejected.
ERRORS, CORRELATION, SLACK = 6.0, 8.0, 1.0
_SPACE, _CODES = 32, 0x110000


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """Code point to its lower-case letter, or to a space."""
    table = np.full(_CODES, _SPACE, np.uint32)
    for cp in range(_CODES):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


@lru_cache(maxsize=1)
def _numbers() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is met, and its number among those that are; reused by each call."""
    return np.zeros(_CODES, bool), np.zeros(_CODES, np.uint64)


def folded(text: str | None) -> np.ndarray:
    """Letters in lower case, everything else as single spaces; empty without letters."""
    cps = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
    out = _folds()[cps]
    blank = out == _SPACE
    out = out[~(blank & np.r_[True, blank[:-1]])] if len(out) else out
    if not len(out) or not (out != _SPACE).any():
        return out[:0]
    tail = [] if out[-1] == _SPACE else [_SPACE]
    return np.concatenate([[_SPACE] * (ORDER - 1), out, tail]).astype(np.uint32)


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First letter, and the other three packed, of each 4-gram."""
    c = codes.astype(np.int64)
    return c[:-3], c[1:-2] << 2 * BITS | c[2:-1] << BITS | c[3:]


def distinct(codes: np.ndarray, inside=slice(None)):
    """First letters and rests of the different 4-grams, each gram's place among them, counts."""
    met, number = _numbers()
    met[codes] = True
    letters = np.flatnonzero(met)
    met[letters] = False
    if len(letters) > 1 << 16:  # too many to pack four of their numbers
        pairs = np.stack(grams(codes), axis=1)[inside]
        found, at, n = np.unique(pairs, axis=0, return_inverse=True, return_counts=True)
        return found[:, 0], found[:, 1], at.reshape(-1), n
    number[letters] = np.arange(len(letters), dtype=np.uint64)
    local, packed = number[codes], 0
    for i in range(ORDER):
        packed = packed | local[i : len(local) - ORDER + 1 + i] << np.uint64(16 * (ORDER - 1 - i))
    found, at, n = np.unique(packed[inside], return_inverse=True, return_counts=True)
    c = [letters[found >> np.uint64(16 * (ORDER - 1 - i)) & np.uint64(0xFFFF)] for i in range(ORDER)]
    return c[0], c[1] << 2 * BITS | c[2] << BITS | c[3], at, n


def _joined(parts: list[np.ndarray]):
    """The texts' codes in one array, which of its 4-grams lie inside a text, and how many in each."""
    lengths = np.array([len(c) for c in parts]) - (ORDER - 1)
    inside = np.ones(lengths.sum() + (len(parts) - 1) * (ORDER - 1), bool)
    starts = np.cumsum(lengths[:-1] + ORDER - 1)
    for back in range(ORDER - 1):
        inside[starts - 1 - back] = False
    return np.concatenate(parts), inside, lengths


def held_out(doc_id: Column) -> Column:
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(FOLDS)) == 0, F.lit(False))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, first, rest, n over the whole labelled training texts."""

    def counted(lang, parts):
        first, rest, _, n = distinct(*_joined(parts)[:2])
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n)), pa.array(first), pa.array(rest), pa.array(n)],
            names=["lang", "first", "rest", "n"],
        )

    def run(batches):
        for b in batches:
            held: dict[str, list] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if len(codes := folded(text)):
                    held.setdefault(lang, []).append(codes)
                    sizes[lang] = sizes.get(lang, 0) + len(codes)
                    if sizes[lang] > PART:
                        yield counted(lang, held.pop(lang))
                        sizes[lang] = 0
            for lang, parts in held.items():
                yield counted(lang, parts)

    learn = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = learn.select("lang", "text").mapInArrow(run, "lang STRING, first BIGINT, rest BIGINT, n BIGINT")
    return rows.groupBy("lang", "first", "rest").agg(F.sum("n").alias("n"))


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Model:
    """Interpolated Kneser-Ney probabilities of one language, in sorted arrays.

    A 4-gram's key is the place of its last three letters among the trigrams, and its first letter.
    """

    def __init__(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray, alphabet: int):
        self.tables, self.contexts = {}, {}
        by_key = np.lexsort((first, rest))
        first, rest, counts = first[by_key], rest[by_key], counts[by_key]
        tri, at, before = np.unique(rest, return_inverse=True, return_counts=True)
        levels = {3: (tri, before), 4: (at << BITS | first, counts)}
        for o in (2, 1):  # number of different characters before
            levels[o] = np.unique(levels[o + 1][0] & self._mask(o), return_counts=True)
        k, c = levels[1]
        d = self._discount(c)
        total = c.sum()
        left = d * len(c) / total
        self.unseen = np.log(max(left, 1e-9) / alphabet)
        self.tables[1] = (k, np.log((c - d) / total + left / alphabet))
        for o in range(2, ORDER + 1):
            k, c = levels[o]
            d = self._discount(c)
            lower = self._lower(rest if o == ORDER else k & self._mask(o - 1), o - 1)
            context = first << 2 * BITS | rest >> BITS if o == ORDER else k >> BITS
            context, own, per = np.unique(context, return_inverse=True, return_counts=True)
            totals = np.bincount(own, c)
            mass = d * per / totals
            self.contexts[o] = (context, np.log(mass))
            lone = mass[own] * np.exp(lower)
            self.tables[o] = (k, np.log((c - d) / totals[own] + lone))
        # what each 4-gram would cost had it been seen once less
        less = np.maximum(c - 1 - d, 0) / np.maximum(totals[own] - 1, 1)
        loss = -np.log(np.maximum(np.where(c > 1, less + lone, lone), 1e-300))
        self.mean = float((loss * c).sum() / c.sum())
        self.deviation = float(np.sqrt(((loss - self.mean) ** 2 * c).sum() / c.sum()))

    @staticmethod
    def _mask(o):
        return (1 << BITS * o) - 1

    @staticmethod
    def _discount(c):
        return _discount(int((c == 1).sum()), int((c == 2).sum()))

    @staticmethod
    def _look(table, keys, missing):
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        hit = table[0][at] == keys
        return hit, np.where(hit, table[1][at], missing), at

    def _lower(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of n-grams of up to three letters."""
        out = self._look(self.tables[1], keys & self._mask(1), self.unseen)[1]
        for o in range(2, order + 1):
            k = keys & self._mask(o)
            backed = out + self._look(self.contexts[o], k >> BITS, 0.0)[1]
            hit, p, _ = self._look(self.tables[o], k, 0.0)
            out = np.where(hit, p, backed)
        return out

    def log_p(self, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
        known, _, at = self._look(self.tables[3], rest, 0.0)
        hit, p, _ = self._look(self.tables[4], at << BITS | first, 0.0)
        mass = self._look(self.contexts[4], first << 2 * BITS | rest >> BITS, 0.0)[1]
        return np.where(known & hit, p, mass + self._lower(rest, 3))

    def limit(self, n: np.ndarray) -> np.ndarray:
        """The highest cross-entropy of a text of n characters that is accepted."""
        return self.mean + ERRORS * self.deviation * np.sqrt(CORRELATION / np.maximum(n, 1)) + SLACK


class Tables:
    """The probabilities of all languages as tables in the shared folder.

    Orders 1 to 3 have the columns lang, gram, p; order 4 has first beside gram. Keys are
    types, not occurrences, so no join key is hot. What is gathered is a row per language.
    """

    def __init__(self, counts: DataFrame):
        levels = {4: counts.withColumnRenamed("rest", "gram")}
        kinds = levels[4].groupBy("lang", "gram").agg(F.count("*").alias("n"))
        levels[3] = stage(kinds, "types")
        for o in (2, 1):
            kinds = levels[o + 1].groupBy("lang", _last(o).alias("gram")).agg(F.count("*").alias("n"))
            levels[o] = stage(kinds, "types")
        alphabet = levels[1].select("gram").distinct().count() + 1
        self.p, self.contexts = {}, {}
        for o, level in sorted(levels.items()):
            sums = level.groupBy("lang").agg(
                F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"),
                F.count("*").alias("types"), F.sum("n").alias("total"),
            ).collect()
            self.names = sorted(r.lang for r in sums)
            cut = {r.lang: _discount(r.once, r.twice) for r in sums}
            d = self.of(cut)
            if o == 1:
                left = {r.lang: cut[r.lang] * r.types / r.total for r in sums}
                self.unseen = {x: max(m, 1e-9) / alphabet for x, m in left.items()}
                p = (F.col("n") - d) / self.of({r.lang: float(r.total) for r in sums}) + self.of(left) / alphabet
                self.p[1] = stage(level.select("lang", "gram", p.alias("p")), "orders")
                continue
            held = level.withColumn("context", _context(o)).groupBy("lang", "context").agg(
                F.count("*").alias("per"), F.sum("n").alias("total")
            )
            mass = (d * F.col("per") / F.col("total")).alias("mass")
            self.contexts[o] = stage(held.select("lang", "context", "total", mass), "contexts")
            lower = self.p[o - 1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows = (
                level.select("*", _context(o).alias("context"), _last(o - 1).alias("suffix"))
                .join(self.contexts[o], ["lang", "context"]).join(lower, ["lang", "suffix"])
            )
            lone = F.col("mass") * F.col("lower")
            p = ((F.col("n") - d) / F.col("total") + lone).alias("p")
            extra = ["n", "total", lone.alias("lone")] if o == ORDER else []
            self.p[o] = stage(rows.select(*_key(o), p, *extra), "orders")
        less = F.greatest(F.col("n") - 1 - d, F.lit(0.0)) / F.greatest(F.col("total") - 1, F.lit(1))
        out = F.when(F.col("n") > 1, less + F.col("lone")).otherwise(F.col("lone"))
        loss = -F.log(F.greatest(out, F.lit(1e-300)))
        n = F.sum("n")
        # the mean first, as the squares of small differences would drown in those of large sums
        self.mean = {r.lang: r.m for r in self.p[4].groupBy("lang").agg((F.sum(loss * F.col("n")) / n).alias("m")).collect()}
        spread = F.sqrt(F.sum(F.pow(loss - self.of(self.mean), F.lit(2.0)) * F.col("n")) / n)
        self.deviation = {r.lang: r.d for r in self.p[4].groupBy("lang").agg(spread.alias("d")).collect()}

    @staticmethod
    def of(values: dict[str, float], lang="lang") -> Column:
        """The value of a row's language."""
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(lang)]

    def look(self, keys: DataFrame, o: int) -> DataFrame:
        """The distinct n-grams ``keys`` with their probability p."""
        if o == 1:
            seen = keys.join(self.p[1], _key(1), "left")
            return seen.select(*_key(1), F.coalesce("p", self.of(self.unseen)).alias("p"))
        below = keys.select("lang", _last(o - 1).alias("gram")).distinct()
        below = self.look(below, o - 1).select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        return (
            keys.select("*", _context(o).alias("context"), _last(o - 1).alias("suffix"))
            .join(below, ["lang", "suffix"])
            .join(self.contexts[o].select("lang", "context", "mass"), ["lang", "context"], "left")
            .join(self.p[o].select(*_key(o), "p"), _key(o), "left")
            .select(*_key(o), F.coalesce("p", F.coalesce("mass", F.lit(1.0)) * F.col("lower")).alias("p"))
        )

    def judge(self, docs: DataFrame) -> DataFrame:
        """Each row of ``docs`` as the struct ``row``, with label, score, entropy, accepted."""

        def split(batches):
            for b in batches:
                for k1, k2, text in zip(*(b.column(c).to_pylist() for c in ("key1", "key2", "text"))):
                    if len(codes := folded(text)):
                        first, rest, _, n = distinct(codes)
                        for at in range(0, len(n), 50_000):
                            part = slice(at, at + 50_000)
                            size = len(n[part])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(size, k1)), pa.array(np.full(size, k2)),
                                 pa.array(first[part]), pa.array(rest[part]), pa.array(n[part])],
                                names=["key1", "key2", "first", "gram", "n"],
                            )

        rows = docs.select(F.struct("*").alias("row"), *text_key(docs["text"]))
        texts = rows.select("key1", "key2", F.col("row.text").alias("text")).dropDuplicates(["key1", "key2"])
        pieces = stage(
            texts.mapInArrow(split, "key1 BIGINT, key2 BIGINT, first BIGINT, gram BIGINT, n BIGINT"), "pieces"
        )
        langs = F.array(*map(F.lit, self.names))
        grams_ = pieces.select("first", "gram").distinct().withColumn("lang", F.explode(langs))
        costs = self.look(grams_, ORDER).groupBy("first", "gram").agg(
            F.sort_array(F.collect_list(F.struct("lang", (-F.log("p")).alias("cost")))).alias("costs")  # one a language
        )
        sums = pieces.join(costs, ["first", "gram"]).groupBy("key1", "key2").agg(
            F.sum("n").alias("length"),
            F.array(*[F.sum(F.col("n") * F.col("costs")[i]["cost"]) for i in range(len(self.names))]).alias("sums"),
        )
        sums = sums.withColumn("costs", F.transform("sums", lambda x: x / F.col("length")))
        sums = sums.withColumn("entropy", F.array_min("costs"))
        sums = sums.withColumn("label", langs[F.array_position("costs", F.col("entropy")).cast("int") - 1])
        reach = F.least(F.col("length"), F.lit(50))
        weight = F.aggregate(
            F.transform("costs", lambda x: F.exp(-(x - F.col("entropy")) * reach)), F.lit(0.0), lambda a, x: a + x
        )
        bound = (
            self.of(self.mean, "label")
            + ERRORS * self.of(self.deviation, "label") * F.sqrt(CORRELATION / F.col("length")) + SLACK
        )
        found = sums.select(
            "key1", "key2", "label", (1.0 / weight).alias("score"), "entropy",
            (F.col("entropy") <= bound).alias("accepted"),
        )
        return rows.join(found, ["key1", "key2"], "left").select(
            "row", F.coalesce("label", F.lit("und")).alias("label"), F.coalesce("score", F.lit(0.0)).alias("score"),
            "entropy", F.coalesce("accepted", F.lit(False)).alias("accepted"),
        )


def _key(o: int) -> list[str]:
    return ["lang", "first", "gram"] if o == ORDER else ["lang", "gram"]


def _last(letters: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * letters) - 1))


def _context(o: int) -> Column:
    before = F.shiftright("gram", BITS)
    return F.shiftleft("first", 2 * BITS).bitwiseOR(before) if o == ORDER else before


def fit(docs: DataFrame) -> dict[str, Model] | Tables:
    """A model per language, from counts over all training rows.

    The types of 4-grams are counted, and gathered only if they are few; all orders
    are the same in either form.
    """
    counts = stage(gram_counts(docs), "grams")
    if not small(counts, 64, MODEL_BYTES):
        return Tables(counts)
    table = counts.toArrow()
    langs = table.column("lang").to_numpy(zero_copy_only=False)
    first, rest, n = (table.column(c).to_numpy() for c in ("first", "rest", "n"))
    alphabet = len(np.unique(rest & Model._mask(1))) + 1
    models = {}
    for lang in sorted(set(langs)):
        mine = langs == lang
        models[lang] = Model(first[mine], rest[mine], n[mine], alphabet)
    return models


def score_texts(texts: list[str | None], models: dict[str, Model]):
    """Label, score (0 to 1), cross-entropy and acceptance of each text."""
    names = list(models)
    label = np.array(["und"] * len(texts), object)
    score, entropy, accepted = np.zeros(len(texts)), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
    if not names:
        return label, score, entropy, accepted
    at = 0
    while at < len(texts):
        codes, rows, size = [], [], 0
        while at < len(texts) and size < PART:
            c = folded(texts[at])
            if len(c):
                codes.append(c)
                rows.append(at)
                size += len(c)
            at += 1
        if not rows:
            continue
        joined, inside, lengths = _joined(codes)
        first, rest, inverse, _ = distinct(joined, inside)
        begin = np.cumsum(np.r_[0, lengths[:-1]])
        costs = np.stack(
            [np.add.reduceat(-models[x].log_p(first, rest)[inverse], begin) / lengths for x in names]
        )
        best = costs.argmin(axis=0)
        low = costs.min(axis=0)
        weight = np.exp(-(costs - low) * np.minimum(lengths, 50))
        for j, row in enumerate(rows):
            label[row] = names[best[j]]
            score[row] = 1.0 / weight[:, j].sum()
            entropy[row] = low[j]
            accepted[row] = low[j] <= models[names[best[j]]].limit(lengths[j])
    return label, score, entropy, accepted


def identify(docs: DataFrame, models: dict[str, Model] | Tables | None = None) -> DataFrame:
    """doc_id, lang_pred, score, entropy (nats per character), accepted: one per row."""
    models = fit(docs) if models is None else models
    if isinstance(models, Tables):
        return models.judge(docs.select("doc_id", "text")).select(
            "row.doc_id", F.col("label").alias("lang_pred"), "score", "entropy", "accepted"
        )
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            label, score, entropy, accepted = score_texts(b.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(label, pa.string()), pa.array(score),
                    pa.array(entropy, from_pandas=True), pa.array(accepted),
                ],
                names=["doc_id", "lang_pred", "score", "entropy", "accepted"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id BIGINT, lang_pred STRING, score DOUBLE, entropy DOUBLE, accepted BOOLEAN"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are rejected, as they are in every column."""
    models = fit(docs)
    if isinstance(models, Tables):
        return models.judge(docs).where("accepted").select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            accepted = score_texts(b.column(at).to_pylist(), shared.value)[3]
            yield b.filter(pa.array(accepted))

    return docs.mapInArrow(run, docs.schema)
