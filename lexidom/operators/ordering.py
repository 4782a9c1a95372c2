"""Row order as data: dense positions, contiguous chunks, and the lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shuffle_partitions, stage

# Rows per lag group. A group is one small sort; each costs one extra row.
CHUNK_ROWS = 1024


def assign_ord(df: DataFrame, order_by: list[str], ord_col: str = "ord") -> DataFrame:
    """Sort by ``order_by`` (unique together) and number rows 0 .. n-1.

    A range shuffle sorts; ids numbered within each sorted partition plus the
    row counts of the partitions before it give the dense position. The sorted
    rows are staged once, so both uses see the same partitions. The result is
    in order, spread over all partitions.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = stage(ranged.withColumn("_place", place), "ordered")
    part = F.shiftright("_place", 33)
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        # One row per range partition.
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.select(*df.columns, (F.col("_start") + within).alias(ord_col))


def assign_ord_within(
    df: DataFrame, by: list[str], order_by: list[str], ord_col: str = "ord"
) -> DataFrame:
    """Number the rows of each segment 0 .. n-1; ``by`` and ``order_by`` are unique together.

    One range shuffle sorts all segments at once. A segment may lie in many
    partitions, and a partition may hold many segments: the rows of a segment
    in the partitions before, and where it begins in the own one, give the position.
    Null is a segment of its own.
    """
    place = F.monotonically_increasing_id()
    keys = [*by, *order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(ranged.withColumn("_place", place), "ordered")
    part = F.shiftright("_place", 33)
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per partition and one more per segment; small ones are broadcast by their size.
    starts = stage(
        placed.groupBy(*by, part.alias("_p"))
        .agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .select(
            *[F.col(c).alias(f"_by_{c}") for c in by], "_p",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"),
        ),
        "starts",
    )
    same = part == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    numbered = placed.join(starts, same)
    return numbered.select(*df.columns, (F.col("_start") + F.col("_place")).alias(ord_col))


def prefix_rows(df: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    """First ``n`` rows in order: a filter, not a sort."""
    return df.where(F.col(ord_col) < n)


def balanced_chunk(position: Column, total: Column, k: int) -> Column:
    """Chunk 0 .. k-1 of a dense position; the first chunks take the rest."""
    size = F.floor(total / k)
    rest = total % k
    wide = rest * (size + 1)
    narrow = rest + F.floor((position - wide) / F.greatest(size, F.lit(1)))
    return F.when(position < wide, F.floor(position / (size + 1))).otherwise(narrow).cast("int")


def assign_chunk(df: DataFrame, k: int, ord_col: str = "ord", out: str = "chunk") -> DataFrame:
    """k contiguous, balanced chunks over dense positions, by arithmetic."""
    total = df.agg((F.max(ord_col) + 1).alias("_total"))
    joined = df.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn(out, balanced_chunk(F.col(ord_col), F.col("_total"), k)).drop("_total")


def with_previous(
    df: DataFrame, value: str = "domain", ord_col: str = "ord", out: str = "prev",
    chunk_rows: int = CHUNK_ROWS, keep_chunk: bool = False, by: list[str] | None = None,
) -> DataFrame:
    """lag(1) over dense positions 0 .. n-1; the first row precedes itself.

    With ``by``, positions are those inside each segment, and no row precedes one of
    another segment.

    Positions with gaps, repeats or nulls are refused: the job fails rather than
    take another row, or none, for the predecessor.

    Positions are cut into chunks, and the last row of a chunk is also sent to
    the next one as context, so each chunk finds its predecessors alone: one
    shuffle, no window over the whole table, no boundary lookup.
    """
    position = F.col(ord_col)
    chunk = F.floor(position / chunk_rows)
    own = F.struct(chunk.alias("_chunk"), F.lit(False).alias("_context"))
    next_ = F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_context"))
    is_last = position % chunk_rows == chunk_rows - 1
    copies = F.when(is_last, F.array(own, next_)).otherwise(F.array(own))
    spread = df.withColumn("_copy", F.explode(copies)).select(*df.columns, "_copy.*")
    spread = spread.repartition(shuffle_partitions(df.sparkSession), *(by or []), "_chunk")
    order = Window.partitionBy(*(by or []), "_chunk").orderBy(ord_col)
    follows = F.lag(ord_col).over(order) == position - 1
    refused = F.raise_error(F.lit(f"{ord_col} must hold each position from 0 once; see assign_ord"))
    first = (position == 0) & F.lag(ord_col).over(order).isNull()
    previous = F.when(first, F.col(value)).when(follows | F.col("_context"), F.lag(value).over(order))
    result = spread.withColumn(out, previous.otherwise(refused)).where(~F.col("_context"))
    return result.drop("_context") if keep_chunk else result.drop("_context", "_chunk")
