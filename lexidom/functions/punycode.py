"""Internationalised host labels (Bootstring, RFC 3492) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The parameters that RFC 3492 gives for host names.
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_PREFIX = "xn--"
_LARGEST = 1 << 31


def _long(x) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The next bias: how far apart the code points of this label lie so far."""
    start = F.when(first, F.floor(delta / _DAMP)).otherwise(F.floor(delta / 2))
    start = start + F.floor(start / points)

    def halve(state: Column, _: Column) -> Column:
        more = state["d"] > (_BASE - _TMIN) * _TMAX // 2
        return F.struct(
            F.when(more, F.floor(state["d"] / (_BASE - _TMIN))).otherwise(state["d"]).alias("d"),
            F.when(more, state["k"] + _BASE).otherwise(state["k"]).alias("k"),
        )

    # deltas are below 2^31, which seven divisions bring under the bound
    steps = F.sequence(F.lit(1), F.lit(7))
    end = F.aggregate(steps, F.struct(_long(start).alias("d"), _long(0).alias("k")), halve)
    return end["k"] + F.floor((_BASE - _TMIN + 1) * end["d"] / (end["d"] + _SKEW))


def _code_points(basic: Column, digits: Column) -> Column:
    """(out, bad): code points of a label from its plain letters and its digits."""
    plain = F.transform(F.filter(F.split(basic, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))

    def step(s: Column, digit: Column) -> Column:
        value = _long(F.call_function("instr", F.lit(_DIGITS), digit) - 1)
        i = s["i"] + value * s["w"]
        t = F.when(s["k"] <= s["bias"] + _TMIN, _long(_TMIN)).when(s["k"] >= s["bias"] + _TMAX, _long(_TMAX)).otherwise(s["k"] - s["bias"])
        ends = value < t  # the last digit of one code point's place
        size = F.size(s["out"]) + 1
        n = s["n"] + F.floor(i / size)
        at = (i % size).cast("int")
        put = F.concat(F.slice(s["out"], F.lit(1), at), F.array(n), F.slice(s["out"], at + 1, size))
        bad = s["bad"] | (value < 0) | (i > _LARGEST) | (s["w"] > _LARGEST) | (
            ends & ((n > 0x10FFFF) | n.between(0xD800, 0xDFFF))
        )
        go = lambda yes, no, name: F.when(bad, s[name]).when(ends, yes).otherwise(no).alias(name)
        return F.struct(
            go(put, s["out"], "out"),
            go(n, s["n"], "n"),
            go(_long(at + 1), i, "i"),
            go(_adapted(i - s["old"], size, s["old"] == 0), s["bias"], "bias"),
            go(_long(at + 1), s["old"], "old"),
            go(_long(1), s["w"] * (_BASE - t), "w"),
            go(_long(_BASE), s["k"] + _BASE, "k"),
            bad.alias("bad"),
        )

    start = F.struct(
        plain.alias("out"), _long(_FIRST).alias("n"), _long(0).alias("i"), _long(_BIAS).alias("bias"),
        _long(0).alias("old"), _long(1).alias("w"), _long(_BASE).alias("k"), F.lit(False).alias("bad"),
    )
    found = F.filter(F.split(digits, ""), lambda c: c != "")
    end = F.aggregate(found, start, step)
    # a place that broke off in the middle is no label
    return F.struct(end["out"].alias("out"), (end["bad"] | (end["w"] != 1)).alias("bad"))


def label_to_unicode(label: Column) -> Column:
    """A label in its letters; one that isn't coded, or coded wrongly, stays as it is."""
    rest = F.substring(F.lower(label), F.lit(len(_PREFIX) + 1), F.length(label))
    basic = F.regexp_extract(rest, r"^(.*)-[^-]*$", 1)
    found = _code_points(basic, F.regexp_extract(rest, r"([^-]*)$", 1))
    hexed = F.array_join(F.transform(found["out"], lambda p: F.lpad(F.hex(p), 8, "0")), "")
    text = F.decode(F.unhex(hexed), "UTF-32")
    fits = F.lower(label).startswith(_PREFIX) & (F.length(rest) > 0) & rest.rlike(r"^[\x00-\x7F]*$")
    return F.when(~fits, label).otherwise(F.when(found["bad"], label).otherwise(text))


def host_to_unicode(host: Column) -> Column:
    """All labels of a host in their letters; hosts without coded labels are left alone."""
    decoded = F.array_join(F.transform(F.split(host, r"\."), label_to_unicode), ".")
    return F.when(F.lower(host).contains(_PREFIX), decoded).otherwise(host)
