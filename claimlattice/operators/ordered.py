"""Ranks, running values and as-of values over groups of any size.

A window sorts a whole group in one task.  Here rows are dealt into ranges of
(group, order), so a group with a third of all rows lies in many of them; each
range works out its own share, and one row for each (group, range) carries
what the ranges before it add up to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``_at`` >> this is the range that a row lies in.
RANGE_BITS = 33

Save = Callable[[DataFrame, str], DataFrame]


def in_ranges(rows: DataFrame, order: list[str], save: Save, name: str = "ranges") -> DataFrame:
    """``rows`` with ``_at``: rises with ``order`` (ascending, nulls first), consecutive within a range.

    Ties are dealt at random by a hash of where a row stands in the input, so
    that even equal rows do not meet in one task.  The result is saved: later
    steps need the numbers to stay as they are.
    """
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*order, "_salt").sortWithinPartitions(*order).drop("_salt")
    return save(dealt.withColumn("_at", F.monotonically_increasing_id()), name)


def range_of(at: str = "_at") -> Column:
    return F.shiftright(at, RANGE_BITS)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null meets null; the keys stand once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def ranked(rows: DataFrame, keys: list[str], order: list[str], save: Save, name: str = "ranked") -> DataFrame:
    """``rows`` with ``row_number, rank, dense_rank, group_size`` (long) over ``keys`` by ``order``.

    As the window functions of these names (ascending, nulls first), whatever
    the sizes of the groups.  Ties get row numbers in any order.  Null keys
    are a group; an empty table gives an empty one.
    """
    value = F.struct(*order)
    dealt = in_ranges(rows, [*keys, *order], save, name).withColumn("_part", range_of())
    own = Window.partitionBy("_part", *keys)
    local = dealt.withColumns(
        {"_n": F.row_number().over(own.orderBy("_at")).cast("long"), "_r": F.rank().over(own.orderBy(*order)).cast("long"), "_d": F.dense_rank().over(own.orderBy(*order)).cast("long")}
    )
    local = save(local, f"{name}-local")
    parts = local.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_d").alias("_kinds"), F.max("_r").alias("_last_rank"), F.min_by(value, "_at").alias("_first"), F.max_by(value, "_at").alias("_last")
    )
    along = Window.partitionBy(*keys).orderBy("_part")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns(
        {"_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_goes_on": F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(along)) & F.lag("_part").over(along).isNotNull(), F.lit(False))}
    )
    # The rank of a range's last value, where that value begins in this range.
    anchor = F.when((F.col("_kinds") > 1) | ~F.col("_goes_on"), F.col("_before") + F.col("_last_rank"))
    parts = parts.withColumn("_anchor", anchor).withColumns(
        {
            "_kinds_before": F.coalesce(F.sum(F.col("_kinds") - F.col("_goes_on").cast("long")).over(earlier), F.lit(0)) - F.col("_goes_on").cast("long"),
            "_first_rank": F.when(F.col("_goes_on"), F.last("_anchor", ignorenulls=True).over(earlier)).otherwise(F.col("_before") + 1),
            "group_size": F.sum("_rows").over(Window.partitionBy(*keys)),
        }
    )
    carried = parts.select(*keys, "_part", "_before", "_kinds_before", "_first_rank", "group_size")
    joined = null_safe(local, carried, [*keys, "_part"])
    rank = F.when(F.col("_r") == 1, F.col("_first_rank")).otherwise(F.col("_before") + F.col("_r"))
    return joined.select(
        *rows.columns, (F.col("_before") + F.col("_n")).alias("row_number"), rank.alias("rank"), (F.col("_kinds_before") + F.col("_d")).alias("dense_rank"), "group_size"
    )


def tile(n: int, row_number: str = "row_number", size: str = "group_size") -> Column:
    """``ntile(n)`` from a row's number and its group's size."""
    rows = F.col(size)
    each, more = F.floor(rows / n), rows % n
    long_ones = more * (each + 1)
    at = F.col(row_number) - 1
    # Groups of fewer than n rows have long tiles (of one row) only.
    return F.when(at < long_ones, F.floor(at / (each + 1))).otherwise(more + F.floor((at - long_ones) / F.greatest(each, F.lit(1)))).cast("int") + 1


def carried_last(rows: DataFrame, keys: list[str], order: list[str], values: Column, save: Save, name: str = "carried") -> DataFrame:
    """``rows`` with ``_last``: the last non-null of ``values`` at or before a row, over ``keys`` by ``order``."""
    dealt = in_ranges(rows.withColumn("_value", values), [*keys, *order], save, name).withColumn("_part", range_of())
    here = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("_here", F.last("_value", ignorenulls=True).over(here))
    ends = dealt.groupBy(*keys, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    joined = null_safe(local, before, [*keys, "_part"])
    return joined.select(*rows.columns, F.coalesce("_here", "_before").alias("_last"))
