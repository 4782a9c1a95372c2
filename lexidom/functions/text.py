"""String functions on columns: the per-row part of the features."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Fixed value: probability of a trigram the table does not know.
UNKNOWN_TRIGRAM_P = 1e-10

# Every white-space character; none lies beyond U+3000.
WHITE_SPACE = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())


@lru_cache(maxsize=None)
def _digit_class() -> str:
    """Decimal digits plus the few other characters that count as digits
    (superscripts, circled digits, ...), as one regular-expression class."""
    ranges: list[list[int]] = []
    for cp in range(128, sys.maxunicode + 1):
        ch = chr(cp)
        if ch.isdigit() and unicodedata.category(ch) != "Nd":
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return r"[\p{Nd}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def char_length(domain: Column) -> Column:
    return F.length(domain).cast("double")


def numerical_ratio(domain: Column) -> Column:
    """Share of digit characters; 0 for the empty string."""
    n = F.length(domain)
    kept = F.length(F.regexp_replace(domain, _digit_class(), ""))
    return F.when(n == 0, F.lit(0.0)).otherwise((n - kept) / n)


def edit_distance(domain: Column, previous: Column) -> Column:
    return F.levenshtein(domain, previous).cast("double")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalized(domain: Column) -> Column:
    """Scoring-time form: surrounding white space removed, lower case."""
    return F.lower(stripped(domain))


def host_of(text: Column) -> Column:
    """Host part of a host, host:port or URL, without trailing dots."""
    plain = ~text.rlike(r"[/?#@:\s。．｡]|\.$")  # nearly every row
    host = F.regexp_replace(text, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    host = F.regexp_extract(host, r"^([^/?#]*)", 1)
    host = F.regexp_replace(host, r"^.*@", "")
    host = F.regexp_replace(host, r":\d*$", "")
    host = F.translate(F.trim(host), "。．｡", "...")
    return F.when(plain, text).otherwise(F.regexp_replace(host, r"\.+$", ""))


def encode_threat(threat: Column) -> Column:
    """1 for exactly 'dga', 0 for every other value."""
    return (threat == "dga").cast("int")


def decode_label(prediction: Column) -> Column:
    return F.when(prediction == 1, "DGA").otherwise("Benign")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of one text, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))
