"""Exact ranks, quotas, splits, folds, samples and medians without big groups.

A class may hold most of the table, so no window here spans a whole class.
Rows are counted per small bucket first, and only one bucket is ever ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage


def hash_of(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k) for k in keys], F.lit(str(seed))))


def cutoffs(
    df: DataFrame, by: list[str], buckets: list[Column], order: Column, *quotas: Column,
    few_classes: bool = True,
) -> DataFrame:
    """For each class and quota q, the q-th smallest ``order`` value (cutoff).

    ``buckets`` are ever finer coarsenings of ``order``. Each level is one
    partial aggregate over the bucket that still holds the wanted row, so the
    last step sees the distinct values of one finest bucket per class. Classes
    with fewer rows than a quota get no row for it. A quota may use ``total``,
    the class size. The located buckets, a row per class and quota, are
    broadcast if there are ``few_classes``.
    """
    # A constant class stands in for "no classes".
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    rows = rows.select(*keys, order.alias("_o"), *[b.alias(f"_b{i}") for i, b in enumerate(buckets)])
    rows = rows.where(F.col("_o").isNotNull())
    located = lambda t: F.broadcast(t) if few_classes else t
    target: DataFrame | None = None
    levels = [f"_b{i}" for i in range(len(buckets))] + ["_o"]
    for i, level in enumerate(levels):
        above = levels[:i]
        if target is None:
            counts = rows.groupBy(*keys, level).agg(F.count("*").alias("_n"))
            counts = counts.withColumn("total", F.sum("_n").over(Window.partitionBy(*keys)))
            wanted = F.posexplode(F.array(*[q.cast("long") for q in quotas])).alias("_q", "_need")
            counts = counts.select("*", wanted)
        else:
            inside = rows.join(located(target), [*keys, *above])
            counts = inside.groupBy(*keys, "_q", "_need", *above, level).agg(F.count("*").alias("_n"))
        running = Window.partitionBy(*keys, "_q").orderBy(level).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        counts = counts.withColumn("_upto", F.sum("_n").over(running))
        counts = counts.where("_need <= _upto and _need > _upto - _n")
        rest = (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need")
        target = counts.select(*keys, "_q", *above, level, rest)
    return target.select(*by, F.col("_o").alias("cutoff"))


def _hash_cutoffs(df: DataFrame, by: list[str], keys: list[str], seed: int, quota: Column):
    """Returns the rows' hash order and the cutoff rows on it."""
    h = hash_of(keys, seed)
    order = F.struct(h.alias("h"), *[F.col(k) for k in keys])
    levels = [F.substring(h, 1, 4), F.substring(h, 5, 4)]
    return order, cutoffs(df, by, levels, order, quota)


def stratified_split(
    df: DataFrame, test_size: float = 0.2, label: str = "label", keys: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: exactly round(test_size * class rows) of each class test.

    Membership follows a seeded hash of ``keys`` (unique, default domain), so
    it is the same on every run and however the rows are partitioned. The
    table itself is not shuffled. Classes are the two label values.
    """
    quota = F.round(F.col("total") * F.lit(test_size))
    order, last = _hash_cutoffs(df, [label], keys or ["domain"], seed, quota)
    placed = df.withColumn("_order", order).join(F.broadcast(last), label, "left")
    in_test = F.coalesce(F.col("_order") <= F.col("cutoff"), F.lit(False))
    return placed.select(*df.columns, F.when(in_test, "test").otherwise("train").alias("split"))


def sample_rows(df: DataFrame, n: int, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement (all, if there are no more)."""
    if n <= 0:
        return df.limit(0)
    order, last = _hash_cutoffs(df, [], keys or ["domain"], seed, F.lit(n))
    placed = df.withColumn("_order", order).join(F.broadcast(last), F.lit(True), "left")
    keep = F.col("cutoff").isNull() | (F.col("_order") <= F.col("cutoff"))
    return placed.where(keep).select(*df.columns)


def _hex_digits(rows: int, rows_per_bucket: int = 50_000) -> int:
    digits = 1
    while rows > rows_per_bucket * 16**digits and digits < 6:
        digits += 1
    return digits


def hash_rank(
    df: DataFrame, label: str = "label", keys: list[str] | None = None, seed: int = 42,
    digits: int | None = None,
) -> DataFrame:
    """Add ``rank``: 1-based place of the row in its class by seeded hash.

    The window runs over (class, hash prefix) groups of about 50,000 rows;
    the prefix counts give each group its starting rank.
    """
    keys = keys or ["domain"]
    digits = digits or _hex_digits(df.count())
    h = hash_of(keys, seed)
    prefix = F.substring(h, 1, digits)
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(F.col(label), prefix.alias("_b"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(label, "_b").orderBy("_h", *keys)
    return (
        df.withColumn("_h", h)
        .withColumn("_b", F.substring("_h", 1, digits))
        .withColumn("_place", F.row_number().over(within))
        .join(starts, [label, "_b"])
        .select(*df.columns, (F.col("_start") + F.col("_place")).alias("rank"))
    )


def stratified_folds(
    df: DataFrame, n_splits: int = 5, label: str = "label", keys: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Add ``fold`` 0 .. n_splits-1, each holding its share of every class."""
    ranked = hash_rank(df, label, keys, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % n_splits).cast("int")).drop("rank")


#: Rows of an interval that one task may rank; wider intervals are narrowed first.
RANKED_ROWS = 100_000
#: Limits that one sketch gives per interval.
_LIMITS = [i / 64 for i in range(1, 64)]


def exact_median(
    df: DataFrame, by: list[str], value: str, out: str = "median", ranked_rows: int = RANKED_ROWS
) -> DataFrame:
    """Exact median per group (mean of the middle two for even counts); NaN is the largest value.

    Quantiles of a sketch cut the interval that holds the wanted rank, whatever the
    spread of the values: a counting pass finds the piece, and pieces of more than
    ``ranked_rows`` rows are cut again. A limit's own value is a piece of its own, so a
    value that most rows hold is counted, not ranked.
    """
    keys = by or ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull())
    rows = rows.select(*keys, F.col(value).alias("_v"), F.col(value).cast("double").alias("_x"))
    total = F.count("*").alias("_n")
    middles = F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    targets = stage(
        rows.groupBy(*keys).agg(total, (F.min("_v") == F.max("_v")).alias("_one")).select(
            *keys, F.posexplode(middles).alias("_q", "_need"),
            F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high"),
            F.lit(False).alias("_closed"), "_n", "_one",
        ),
        "targets",
    )
    while not targets.where(_wide(ranked_rows)).isEmpty():
        narrow = targets.where(~_wide(ranked_rows))
        targets = stage(narrow.unionByName(_narrowed(rows, targets.where(_wide(ranked_rows)), keys)), "targets")
    inside = _inside(rows, targets, keys).groupBy(*keys, "_q", "_need", "_v").agg(F.count("*").alias("_k"))
    running = Window.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("_upto", F.sum("_k").over(running)).where("_need <= _upto AND _need > _upto - _k")
    return found.groupBy(*keys).agg(F.avg("_v").alias(out)).select(*by, out)


def _wide(ranked_rows: int) -> Column:
    return (F.col("_n") > ranked_rows) & ~F.col("_one")


def _inside(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each target's interval: above low and below high, or at high if closed; low is high for one value."""
    few = targets.count() <= 100_000
    x, high = F.col("_x"), F.col("_high")
    within = (
        (F.col("_low").isNull() | (x > F.col("_low")) | ((F.col("_low") == high) & (x == high)))
        & (high.isNull() | (x < high) | (F.col("_closed") & (x == high)))
    )
    return rows.join(F.broadcast(targets) if few else targets, keys).where(within)


def _narrowed(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    ids = [*keys, "_q"]
    inside = _inside(rows, targets, keys)
    number = F.when(~F.isnan("_x"), F.col("_x"))
    sketch = F.kll_sketch_agg_double(number)
    quantiles = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(r) for r in _LIMITS]))
    limits = inside.groupBy(*ids).agg(
        F.when(F.count(number) > 0, quantiles).alias("_limits"), F.max("_x").alias("_top")
    ).select(*ids, F.array_sort(F.array_distinct(F.concat(F.coalesce("_limits", F.array().cast("array<double>")), F.array("_top")))).alias("_limits"))
    limits = stage(limits, "limits")
    few = limits.count() <= 100_000
    # the limit at or above the value, and whether it is the value
    limit = F.element_at(F.filter("_limits", lambda x: x >= F.col("_x")), 1)
    pieces = (
        inside.join(F.broadcast(limits) if few else limits, ids)
        .withColumn("_at", limit)
        .groupBy(*ids, "_need", F.col("_low").alias("_from"), "_at", (F.col("_x") == F.col("_at")).alias("_own"))
        .agg(F.count("*").alias("_k"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    order = Window.partitionBy(*ids).orderBy("_at", "_own")  # two pieces a limit
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("_upto", F.sum("_k").over(running)).withColumn(
        "_before", F.lag("_at").over(order)
    ).where("_need <= _upto AND _need > _upto - _k")
    below = F.coalesce(F.col("_before"), F.col("_from"))
    return pieces.select(
        *ids, (F.col("_need") - F.col("_upto") + F.col("_k")).alias("_need"), F.when(F.col("_own"), F.col("_at")).otherwise(below).alias("_low"),
        F.col("_at").alias("_high"), F.col("_own").alias("_closed"), F.col("_k").alias("_n"),
        # whole numbers that share a double are few
        (F.col("_own") | (F.col("_min") == F.col("_max"))).alias("_one"),
    )
