"""Raw log to cleaned, labelled domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.punycode import host_to_unicode
from ..functions.text import host_of
from ..session import fits_broadcast
from .ranking import cutoffs


def strip_suffix(
    df: DataFrame, rules: DataFrame, domain: str = "domain", idna: bool = False
) -> DataFrame:
    """Remove the public suffix, keep any subdomain ('a.b.co.uk' -> 'a.b').

    One broadcast lookup per suffix depth of the rule table (a handful), so
    rows are never exploded or shuffled. The longest rule wins, a wildcard
    covers one more label, and an exception wins over all and covers one less.
    A host that matches no rule, or is an IPv4 address, stays whole. With ``idna``
    coded labels (xn--) and letters match each other; the host keeps its spelling.
    """
    if idna:
        rules = _decoded(rules)
    depth = rules.agg(F.max("labels")).first()[0] or 0
    small = fits_broadcast(rules, "rule")
    host = "_host"
    out = df.withColumn(host, host_of(F.col(domain)))
    look = "_look" if idna else host
    if idna:
        out = out.withColumn(look, host_to_unicode(F.col(host)))
    parts = F.size(F.split(host, r"\."))
    taken: Column = F.lit(0)
    exempt: Column = F.lit(None).cast("int")
    for i in range(1, depth + 1):
        level = rules.where(F.col("labels") == i).select(
            F.col("rule").alias(f"_rule{i}"),
            F.struct("plain", "wildcard", "exception").alias(f"_kind{i}"),
        )
        tail = F.when(parts >= i, F.substring_index(look, ".", -i))
        out = out.withColumn(f"_tail{i}", tail).join(
            F.broadcast(level) if small else level, F.col(f"_tail{i}") == F.col(f"_rule{i}"), "left"
        )
        kind = F.col(f"_kind{i}")
        here = F.when(kind["wildcard"] & (parts > i), i + 1).when(kind["plain"], i).otherwise(0)
        taken = F.greatest(taken, F.coalesce(here, F.lit(0)))
        exempt = F.coalesce(F.when(kind["exception"], i - 1), exempt)
    suffix_labels = F.when(F.col(host).rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), 0).otherwise(
        F.coalesce(exempt, taken)
    )
    kept = F.call_function("substring_index", F.col(host), F.lit("."), parts - suffix_labels)
    stripped = F.when(suffix_labels == 0, F.col(host)).otherwise(kept)
    columns = [stripped.alias(domain) if c == domain else F.col(c) for c in df.columns]
    return out.select(*columns)


def _decoded(rules: DataFrame) -> DataFrame:
    """Rules in letters; the two spellings of one rule become one row."""
    kinds = [F.bool_or(c).alias(c) for c in ("plain", "wildcard", "exception")]
    letters = rules.withColumn("rule", host_to_unicode(F.col("rule")))
    return letters.groupBy("rule", "labels").agg(*kinds)


def dedup_benign_wins(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row per domain: the benign one if any, then the earliest.

    Plain minima, so a domain repeated in a third of all rows is folded on the
    map side and nothing is ranked.
    """
    if order is None:
        return df.groupBy("domain").agg(F.min("label").alias("label"))
    first_of = {v: F.min(F.when(F.col("label") == v, F.col(order))) for v in (0, 1)}
    return df.groupBy("domain").agg(
        F.min("label").alias("label"), F.coalesce(first_of[0], first_of[1]).alias(order)
    )


def clean(df: DataFrame, rules: DataFrame, order: str | None = None) -> DataFrame:
    """Lower case, strip suffix, drop empty, deduplicate. Order comes after.

    Repeats are folded before the suffixes too, so those are looked up once a domain.
    """
    lowered = dedup_benign_wins(df.withColumn("domain", F.lower("domain")), order)
    stripped = strip_suffix(lowered, rules).where("domain <> ''")
    return dedup_benign_wins(stripped, order)


def cap_per_class(
    df: DataFrame, cap: int = 500_000, label: str = "label", order: str = "ord"
) -> DataFrame:
    """The first ``cap`` rows of each class in ``order``.

    Counts per stretch of ``order`` locate each class's last admitted value;
    the rows themselves are then only filtered, never ranked or shuffled.
    Classes are the two values of an encoded label.
    """
    stretch = [F.shiftright(order, 32), F.shiftright(order, 16)]
    last = cutoffs(df, [label], stretch, F.col(order), F.lit(cap))
    bounded = df.join(F.broadcast(last), label, "left")
    admitted = F.col("cutoff").isNull() | (F.col(order) <= F.col("cutoff"))
    return bounded.where(admitted).select(*df.columns)


def merge_classes(benign: DataFrame, dga: DataFrame) -> DataFrame:
    """Benign rows, then DGA rows; ``source_rank`` keeps which came first."""
    return benign.withColumn("source_rank", F.lit(0)).unionByName(
        dga.withColumn("source_rank", F.lit(1))
    )
