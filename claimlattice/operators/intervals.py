"""Overlap join of intervals of any length.

Bins as wide as the longest interval would put nearly all rows into few bins.
Here an interval has a level, the bits of its length, and bins of its level
are just wider than it is, so it lies in one or two of them.  Of two intervals
the shorter one looks in the bins of the longer one's level, where it, too,
lies in one or two.  A pair counts only in the bin where its overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_of(start: str, end: str) -> Column:
    return F.length(F.bin(F.col(end) - F.col(start)))


def bins_of(start: str, end: str, level: Column) -> Column:
    low, high = F.call_function("shiftright", F.col(start), level), F.call_function("shiftright", F.col(end), level)
    return F.explode(F.sequence(low, high))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` with equal ``keys`` whose intervals meet: all columns of both, the keys once.

    ``a`` has ``a_start, a_end`` and ``b`` has ``b_start, b_end`` (long,
    closed); other columns must differ by name.  Intervals with a null end or
    that end before they start, and rows of null keys, meet nothing.  Repeated
    rows pair as often as they stand.
    """
    a = a.filter("a_end >= a_start").withColumn("a_level", level_of("a_start", "a_end"))
    b = b.filter("b_end >= b_start").withColumn("b_level", level_of("b_start", "b_end"))
    found = None
    for held, h, probing, p, strict in ((a, "a", b, "b", False), (b, "b", a, "a", True)):
        # At most 64 levels, whatever the data.
        levels = [r[0] for r in held.select(f"{h}_level").distinct().collect()]
        level = F.col("_level")
        homes = held.withColumn("_level", F.col(f"{h}_level")).withColumn("_bin", bins_of(f"{h}_start", f"{h}_end", level))
        reach = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col(f"{p}_level") if strict else x >= F.col(f"{p}_level"))
        visits = probing.withColumn("_level", F.explode(reach)).withColumn("_bin", bins_of(f"{p}_start", f"{p}_end", level))
        met = homes.join(visits, [*keys, "_level", "_bin"])
        met = met.filter((F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")))
        met = met.filter(F.col("_bin") == F.call_function("shiftright", F.greatest("a_start", "b_start"), level))
        met = met.drop("_level", "_bin", "a_level", "b_level")
        found = met if found is None else found.unionByName(met)
    return found
