"""Keyed surrogates for personal data.

Entities found in a text are replaced by made-up values of the same type and
format: digits for digits, vowels and consonants of the same script and case for
letters, valid octets and check digits, first names of the same gender and script.
A surrogate is a keyed hash of the entity, so an entity has the same one wherever
it stands. The distinct entities of the whole table are checked: a surrogate that
two of them share, or that equals a real entity, is drawn again for all but the
smallest; only the clashing ones are written again. What still clashes after DRAWS draws gets a free value by number: the
values of its form are counted through, in blocks that double, and beyond the last
the form is widened by letters or digits, until all are distinct. Only those
exceptions are joined back.

Defined cases: null texts stay null and have no entities; repeated rows are each
returned; other columns are ignored; an empty table gives none; a very long text takes
time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage
from .common import small, text_key

# First names by script and gender.
FIRST_NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carmen Clara Elena Emma Helen Ingrid Julia Laura Linda Maria Mary Nina Olivia Patricia Sarah Sofia Susan".split(),
    ("latin", "m"): "Adam Alexander Carlos Daniel David Edward Frank George Hans James John Jose Juan Michael Paul Peter Pierre Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Παύλος".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Herr Frau Madame Monsieur Señor Señora".split()
# Letters by script, vowels first.
ALPHABETS = (
    ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
    ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
)

#: Random draws before free values are looked for by number.
DRAWS = 64
#: Values of a form looked at for each of its clashes at first; twice as many each time.
BLOCK = 16

_NAMES = {n: (kind, i) for kind, ns in FIRST_NAMES.items() for i, n in enumerate(ns)}
_LETTER = {}
for _group in (g for pair in ALPHABETS for g in pair):
    for _c in _group:
        _LETTER[_c], _LETTER[_c.upper()] = _group, _group.upper()

_FINDERS = [
    ("secret", re.compile(r"\bAKIA[0-9A-Z]{16}\b")),
    ("secret", re.compile(r"(?i)\b(?:token|password|passwd|pwd|secret|api[_-]?key)\s*[=:]\s*[\"']?([^\s\"']{6,})")),
    ("email", re.compile(r"@[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}\b")),  # and what stands before
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("card", re.compile(r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-])")),
    ("ssn", re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\w)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])")),
]
_DIGITS = "0123456789"
_DIGIT = re.compile(r"[0-9]")
_KEYWORD = re.compile(r"(?i)token|passw|pwd|secret|api[_-]?key")
_WORD = r"[^\W\d_]"
_TOKEN = re.compile(r"\w+")
_FULL_NAME = re.compile(rf"\b({'|'.join(sorted(_NAMES, key=lambda n: (-len(n), n)))}) ({_WORD}[\w'’\-]*{_WORD})")
_TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? ({_WORD}[\w'’\-]*{_WORD})")


def _mails(text: str, host: re.Pattern):
    """Addresses, from each @ backwards: a long run of letters is read once, not from each of its places."""
    end = 0
    for m in host.finditer(text):
        start = m.start()
        while start > end and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def _again(text: str, names: set[str]):
    """Places of the names as whole words, the longest at each."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    most = max(len(_TOKEN.findall(n)) for n in names)
    i = 0
    while i < len(tokens):
        start, last = tokens[i][0], None
        for j in range(i, min(i + most, len(tokens))):
            if j > i and text[tokens[j - 1][1] : tokens[j][0]].strip("'’-"):
                break
            if text[start : tokens[j][1]] in names:
                last = j
        if last is not None:
            yield start, tokens[last][1]
        i = (i if last is None else last) + 1


def find(text: str) -> list[tuple[int, int, str]]:
    """start, end, type of the entities, in order and without overlap; earlier types win."""
    found: list[tuple[int, int, str]] = []
    digit = bool(_DIGIT.search(text))
    for kind, pattern in _FINDERS:
        if kind == "email" and "@" not in text:
            continue
        if kind == "secret" and not (_KEYWORD.search(text) or "AKIA" in text):
            continue
        if kind not in ("email", "secret") and not digit:
            continue
        if kind == "email":
            found += [(*span, kind) for span in _mails(text, pattern)]
            continue
        for m in pattern.finditer(text):
            found.append((*(m.span(1) if pattern.groups else m.span()), kind))
    # both patterns begin with a whole listed token, whatever signs stand around it
    words = set(_TOKEN.findall(text))
    if not words.isdisjoint(_NAMES) or not words.isdisjoint(TITLES):
        first, family = set(), set()
        for m in _FULL_NAME.finditer(text):
            if m[2][0].isupper():
                found += [(*m.span(1), "first"), (*m.span(2), "family")]
                first.add(m[1])
                family.add(m[2])
        for m in _TITLED.finditer(text):
            if m[1][0].isupper() and m[1] not in _NAMES:
                found.append((*m.span(1), "family"))
                family.add(m[1])
        for kind, names in (("family", family), ("first", first)):
            if names:  # the same person named again by one name alone
                found += [(*span, kind) for span in _again(text, names)]
    taken, out = bytearray(len(text) if found else 0), []
    for start, end, kind in found:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, kind))
    return sorted(out)


def identity(value: str, kind: str) -> str:
    """What two spellings of one entity have in common."""
    if kind in ("phone", "card", "ssn", "iban"):
        return re.sub(r"[^0-9A-Za-z]", "", value).upper()
    return value.lower() if kind == "email" else value


def _stream(key: bytes, *parts):
    counter = 0
    while True:
        text = "\0".join([*map(str, parts), str(counter)]).encode("utf-8", "replace")
        yield from hashlib.blake2b(text, key=key).digest()
        counter += 1


class _Number:
    """In place of a stream: the picks that make value ``left`` of a form, and what is left of it."""

    def __init__(self, left: int):
        self.left = left

    def pick(self, options):
        self.left, at = divmod(self.left, len(options))
        return options[at]

    def more(self, options) -> str:
        """Further letters for a number beyond the form; each number has its own."""
        out = ""
        while self.left:
            self.left -= 1
            out += self.pick(options)
        return out


def _pick(stream, options):
    if isinstance(stream, _Number):
        return stream.pick(options)
    n = len(options)
    limit = 256 - 256 % n
    while (b := next(stream)) >= limit:
        pass
    return options[b % n]


def _alike(ch, stream):
    if "0" <= ch <= "9":
        return _pick(stream, "0123456789")
    group = _LETTER.get(ch)
    return _pick(stream, group) if group else ch


def _check_digit(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _email_domain(domain, key):
    """The same host gets the same surrogate; the last label stays."""
    stream = _stream(key, "domain", domain.lower())
    host, _, top = domain.rpartition(".")
    return "".join(_alike(c, stream) for c in host) + "." + top


def surrogate(value: str, kind: str, key: bytes, attempt: int = 0) -> str:
    """A value of the same form; the same for all spellings of one entity.

    Attempts below zero are the values of the form by number (-1 the first), then of wider forms.
    """
    stream = _Number(-1 - attempt) if attempt < 0 else _stream(key, kind, identity(value, kind), attempt)
    more = stream.more if attempt < 0 else lambda options: ""
    if kind == "first":
        names = FIRST_NAMES[_NAMES[value][0]]
        at = names.index(value)
        # a keyed turn of the list keeps names distinct; it never maps a name to itself
        turn = next(_stream(key, "first", *_NAMES[value][0])) % (len(names) - 1) + 1
        return names[(at + turn) % len(names)]
    if kind == "ip":
        spans = {1: range(1, 10), 2: range(10, 100), 3: range(100, 255)}
        sizes = [len(p) for p in value.split(".")]
        if attempt < 0:  # a full form gets more digits, the shortest part first
            while stream.left >= (n := math.prod(len(spans[x]) for x in sizes)) and min(sizes) < 3:
                stream.left -= n
                sizes[sizes.index(min(sizes))] += 1
        new = ".".join(str(_pick(stream, spans[x])) for x in sizes)
        return new + (f".{99 + stream.left}" if attempt < 0 and stream.left else "")
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return "".join(_alike(c, stream) for c in local) + more(_DIGITS) + "@" + _email_domain(domain, key)
    if kind in ("phone", "card", "ssn", "iban"):
        plain = identity(value, kind)
        code = re.match(r"\+(\d{1,3})(?=[ .\-(])", value)
        keep = {"card": 1, "iban": 2, "phone": len(code[1]) if code else 0, "ssn": 0}[kind]
        new = plain[:keep] + "".join(_alike(c, stream) for c in plain[keep:])
        if kind == "phone" and len(new) > keep and new[keep] in "01":
            new = new[:keep] + _pick(stream, "23456789") + new[keep + 1 :]
        valid = kind == "card" and _check_digit(plain[:-1]) == plain[-1]
        new += more(_DIGITS)
        if valid:
            new = new[:-1] + _check_digit(new[:-1])
        fresh = iter(new)
        return "".join([next(fresh) if c.isalnum() else c for c in value] + [*fresh])
    if kind == "secret":
        keep = 4 if value.startswith("AKIA") else 0
        hexa = re.fullmatch(r"[0-9a-f]+", value)
        rest = (_pick(stream, "0123456789abcdef") if hexa else _alike(c, stream) for c in value[keep:])
        return value[:keep] + "".join(rest) + more(_DIGITS)
    new = "".join(_alike(c, stream) for c in value)
    return new + more(_LETTER.get(value[-1].lower(), ALPHABETS[0][1]))


def _form(value: str, kind: str, key: bytes) -> str:
    """What entities whose numbered values are the same have in common."""
    return "\0".join(identity(surrogate(value, kind, key, n), kind) for n in (-1, -2))


def replace(text: str, key: bytes, attempts: dict) -> tuple[str, list[dict]]:
    """The text with surrogates, and the type and new place of each."""
    out, spans, at, size = [], [], 0, 0
    for start, end, kind in find(text):
        value = text[start:end]
        new = surrogate(value, kind, key, attempts.get((kind, identity(value, kind)), 0))
        size += start - at
        out += [text[at:start], new]
        spans.append({"type": kind, "start": size, "end": size + len(new)})
        size += len(new)
        at = end
    return "".join([*out, text[at:]]) if out else text, spans


def distinct_entities(docs: DataFrame) -> DataFrame:
    """type, value (identity), sample (one spelling) over the whole table."""

    def run(batches):
        for b in batches:
            seen: dict[tuple[str, str], str] = {}
            for text in b.column("text").to_pylist():
                for s, e, kind in find(text or ""):
                    who = kind, identity(text[s:e], kind)
                    seen[who] = min(seen.get(who, text[s:e]), text[s:e])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                 pa.array(list(seen.values()), pa.string())],
                names=["type", "value", "sample"],
            )

    rows = docs.select("text").mapInArrow(run, "type STRING, value STRING, sample STRING")
    return rows.groupBy("type", "value").agg(F.min("sample").alias("sample"))


def checked_attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """type, value, attempt (not 0) of the entities whose first surrogate was not free."""

    def draw(batches):
        for b in batches:
            new = [
                identity(surrogate(s, t, key, n), t)
                for t, s, n in zip(*(b.column(c).to_pylist() for c in ("type", "sample", "attempt")))
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "new"])

    schema = "type STRING, value STRING, sample STRING, attempt BIGINT, new STRING"
    # first names turn as a list: distinct by construction, and meant to be names
    entities = stage(entities.where("type != 'first'"), "entities")
    real = entities.select("type", F.col("value").alias("new"))
    drawn = entities.withColumn("attempt", F.lit(0).cast("bigint")).mapInArrow(draw, schema)
    settled, taken, rounds, tried = [], real, 0, None
    while True:
        drawn = stage(drawn, "surrogates")
        holders = drawn.groupBy("type", "new").agg(F.min("value").alias("holder"))
        # a value is taken once: it is real, or one entity's that has settled
        judged = drawn.join(holders, ["type", "new"]).join(
            taken.withColumn("taken", F.lit(True)), ["type", "new"], "left"
        )
        clash = (F.col("value") != F.col("holder")) | F.col("taken").isNotNull()
        judged = stage(judged.select("type", "value", "sample", "attempt", "new", clash.alias("clash")), "judged")
        settled.append(judged.where("not clash").select("type", "value", "attempt"))
        if judged.where("clash").limit(1).count() == 0:
            break
        taken = taken.unionByName(judged.where("not clash").select("type", "new"))
        rounds += 1
        if rounds < DRAWS:
            again = judged.where("clash").select("type", "value", "sample", F.lit(rounds).cast("bigint").alias("attempt"))
            drawn = again.mapInArrow(draw, schema)
        else:
            drawn, tried = _numbered(judged.where("clash").drop("clash"), taken, tried, rounds - DRAWS, key, draw)
    return reduce(DataFrame.unionByName, settled).where("attempt != 0")


def _numbered(clashing: DataFrame, taken: DataFrame, tried, step: int, key: bytes, draw):
    """``clashing`` with free values for as many rows as a block of each form's values has,
    and the numbers (type, form, upto) that were looked at so far."""

    def shape(batches):
        for b in batches:
            forms = [_form(s, t, key) for t, s in zip(b.column("type").to_pylist(), b.column("sample").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forms, pa.string())], names=[*b.schema.names, "form"])

    names = "type STRING, value STRING, sample STRING, attempt BIGINT, new STRING"
    open_ = stage(clashing.mapInArrow(shape, names + ", form STRING"), "clashes")
    forms = open_.groupBy("type", "form").agg(F.count("*").alias("n"), F.min("sample").alias("sample"))
    if tried is not None:
        forms = forms.join(tried, ["type", "form"], "left")
    else:
        forms = forms.withColumn("upto", F.lit(0).cast("bigint"))
    block = F.col("n") * F.lit(BLOCK << min(step, 32))
    forms = stage(forms.withColumn("upto", F.coalesce("upto", F.lit(0))).withColumn("end", F.col("upto") + block), "forms")
    asked = forms.select(
        "type", F.col("form").alias("value"), "sample",
        F.explode(F.sequence(-1 - F.col("upto"), -F.col("end"))).alias("attempt"),
    )
    values = asked.mapInArrow(draw, names).join(taken, ["type", "new"], "left_anti")
    values = values.groupBy("type", "new").agg(F.max(F.struct("attempt", "value")).alias("v"))
    place = Window.partitionBy("type", "form")
    free = values.select(
        "type", F.col("v.value").alias("form"), F.col("v.attempt").alias("attempt"), "new",
    ).withColumn("place", F.row_number().over(place.orderBy(F.desc("attempt"))))
    ranked = open_.withColumn("place", F.row_number().over(place.orderBy("value")))
    given = ranked.drop("attempt", "new").join(free, ["type", "form", "place"]).select(
        "type", "value", "sample", "attempt", "new"
    )
    given = stage(given, "numbered")
    waiting = open_.drop("form").join(given.select("type", "value"), ["type", "value"], "left_anti")
    seen = forms.select("type", "form", F.col("end").alias("upto"))
    if tried is not None:
        seen = seen.unionByName(tried.join(forms.select("type", "form"), ["type", "form"], "left_anti"))
    return given.unionByName(waiting), stage(seen, "seen")


def anonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, entities (type, start, end in the new text): one row per row."""
    secret = hashlib.blake2b(key.encode()).digest()
    late = stage(checked_attempts(distinct_entities(docs), secret), "attempts")
    span = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    few = small(late, 256)
    if few:
        table = {(r.type, r.value): r.attempt for r in late.collect()}
        rows = docs.select("doc_id", "text", F.lit(None).cast("array<struct<type: string, value: string, attempt: bigint>>").alias("late"))
    else:
        table, rows = {}, _with_attempts(docs, late)

    def run(batches):
        for b in batches:
            texts, spans = [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("late").to_pylist()):
                known = {(x["type"], x["value"]): x["attempt"] for x in own} if own else table
                new, found = replace(text, secret, known) if text is not None else (None, [])
                texts.append(new)
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, span)],
                names=["doc_id", "text", "entities"],
            )

    return rows.mapInArrow(
        run, "doc_id BIGINT, text STRING, entities ARRAY<STRUCT<type: STRING, start: BIGINT, end: BIGINT>>"
    )


def _with_attempts(docs: DataFrame, late: DataFrame) -> DataFrame:
    """doc_id, text, late: each row with the exceptions among its own entities."""

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for k1, k2, text in zip(*(b.column(c).to_pylist() for c in ("key1", "key2", "text"))):
                for kind, value in {(k, identity(text[s:e], k)) for s, e, k in find(text or "")}:
                    for column, x in zip(out, (k1, k2, kind, value)):
                        column.append(x)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["key1", "key2", "type", "value"]
            )

    keyed = docs.select("doc_id", "text", *text_key(docs["text"]))
    held = keyed.mapInArrow(run, "key1 BIGINT, key2 BIGINT, type STRING, value STRING")
    lists = held.distinct().join(late, ["type", "value"]).groupBy("key1", "key2").agg(
        F.collect_list(F.struct("type", "value", "attempt")).alias("late")  # of one text
    )
    return keyed.join(lists, ["key1", "key2"], "left").select("doc_id", "text", "late")
