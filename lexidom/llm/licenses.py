"""Search for license notices, exact and with a bounded number of edits.

A notice may differ from its wording by k edits. Cut into k + 1 pieces, at least
one piece then stands unchanged (pigeonhole); exact search for the pieces finds
the places, and bounded-error matching of the regex library verifies the few
words around them and gives the spans.

Defined cases: null and wordless texts have no words and no labels; repeated rows
are each returned; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Phrases whose exact places are counted, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Short notices that are found with edits, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under the apache license version": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
}
LETTERS_PER_EDIT = 10

_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def edits(notice: str) -> int:
    return max(1, len(notice) // LETTERS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length with their offsets."""
    n = edits(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=None)
def _searcher(notices: tuple[tuple[str, str], ...]):
    seeds: dict[str, list] = {}
    patterns = []
    for i, (notice, label) in enumerate(notices):
        body = regex.escape(notice, special_only=True, literal_spaces=True)
        patterns.append(
            (regex.compile(rf"(?b)\b(?:{body}){{e<={edits(notice)}}}\b"), label, len(notice))
        )
        for offset, piece in pieces(notice):
            seeds.setdefault(piece, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, patterns


def fuzzy_spans(line: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, str, int]]:
    """start, end (characters of ``line``), label, edits of the verified matches."""
    automaton, patterns = _searcher(notices)
    windows: dict[int, list] = {}
    for end, (size, places) in automaton.iter(line):
        for i, offset in places:
            slack = edits(notices[i][0]) + 1
            at = end + 1 - size - offset
            lo, hi = max(0, at - slack), min(len(line), at + patterns[i][2] + slack)
            open_ = windows.setdefault(i, [])
            if open_ and open_[-1][1] >= lo:
                open_[-1][0] = min(open_[-1][0], lo)
                open_[-1][1] = max(open_[-1][1], hi)
            else:
                open_.append([lo, hi])
    found = set()
    for i, ranges in windows.items():
        pattern, label, _ = patterns[i]
        for lo, hi in ranges:
            # a window must not begin or end inside a word, where \b would lie
            while lo > 0 and line[lo - 1] != " ":
                lo -= 1
            while hi < len(line) and line[hi] != " ":
                hi += 1
            # the best match of a part comes first; others may lie before and after it
            parts = [(lo, hi)]
            while parts:
                lo, hi = parts.pop()
                m = pattern.search(line, lo, hi)
                if m is None or m.start() == m.end():
                    continue
                text = m.group()
                start = m.start() + len(text) - len(text.lstrip())
                end = start + len(text.strip())
                found.add((start, end, label, sum(m.fuzzy_counts)))
                least = patterns[i][2] - edits(notices[i][0])
                parts += [(a, b) for a, b in ((lo, start), (end, hi)) if b - a >= least]
    return sorted(found)


def scan_text(text: bytes, phrases, notices):
    """Words, exact places (word index, label) and fuzzy spans of one text."""
    words = text.translate(_LOWER).split()
    line = b" ".join(words)
    framed, places = b" " + line + b" ", []
    for phrase, label in phrases:
        needle = b" " + phrase.encode() + b" "
        at = framed.find(needle)
        while at >= 0:
            places.append((framed.count(b" ", 0, at), label))
            at = framed.find(needle, at + 1)
    plain = line.decode("utf-8", "replace")
    spans = [
        {"start": plain.count(" ", 0, s), "end": plain.count(" ", 0, e) + 1, "label": lab, "edits": k}
        for s, e, lab, k in fuzzy_spans(plain, notices)
    ]
    return len(words), places, spans


def scan_licenses(docs: DataFrame, phrases=None, notices=None) -> DataFrame:
    """doc_id, n_words, places (word, label: exact phrases), spans (start and end in
    words, label, edits: notices within their bound of edits)."""
    phrases = tuple((phrases or PHRASES).items())
    notices = tuple((notices or NOTICES).items())
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span = pa.list_(
        pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]
        )
    )

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            rows = [scan_text(t.as_py() or b"", phrases, notices) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in r[1]] for r in rows], place),
                    pa.array([r[2] for r in rows], span),
                ],
                names=["doc_id", "n_words", "places", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id BIGINT, n_words BIGINT, places ARRAY<STRUCT<word: BIGINT, label: STRING>>, "
        "spans ARRAY<STRUCT<start: BIGINT, end: BIGINT, label: STRING, edits: BIGINT>>",
    )
