"""Exact quantiles of few giant groups, by histograms refined pass by pass.

An exact percentile by aggregation keeps all values of a group in one task.
Here each pass counts values in equal bins between the least and greatest
value that a wanted rank may still have; the bin that holds the rank becomes
the next range.  A task holds a row for each group and bin, never values, until
at most ``SMALL`` of them are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Save, null_safe

BINS = 1024
SMALL = 4096


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], save: Save, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """``keys`` and a column for each of ``wanted`` (name: column and share), interpolated between neighbours.

    Nulls, NaN and infinite values do not count; a group without values has no
    row; null keys are a group.
    """
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, (c, _) in wanted.items()])
    values = rows.select(*keys, F.explode(each).alias("x")).select(*keys, "x.name", "x.v").filter("v is not null and not isnan(v) and abs(v) < double('inf')")
    group, span = [*keys, "name"], [*keys, "name", "lo", "hi"]
    share = F.element_at(F.create_map(*[F.lit(x) for n, (_, q) in wanted.items() for x in (n, q)]), F.col("name"))
    sizes = values.groupBy(*group).agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = share * (F.col("inside") - 1)
    ranks = F.array(F.struct(F.lit(0).alias("side"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("rank")))
    sizes = sizes.withColumn("part", place - F.floor(place)).withColumn("r", F.explode(ranks))
    targets = save(sizes.select(*group, "part", "r.side", "r.rank", F.lit(0).cast("long").alias("below"), "inside", "lo", "hi"), "targets-0")

    wide, n = (F.col("lo") < F.col("hi")) & (F.col("inside") > small), 0
    while not targets.filter(wide).isEmpty():
        n += 1
        open_spans = targets.filter(wide).select(*span).distinct()
        met = null_safe(values, open_spans, group).filter("v between lo and hi")
        at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = met.groupBy(*span, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*span).orderBy("bin"))
        counts = counts.withColumn("before", upto - F.col("n"))
        moved = null_safe(targets.filter(wide), counts, span).filter("rank - below >= before and rank - below < before + n")
        moved = moved.select(*group, "part", "side", "rank", (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("inside"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        targets = save(moved.unionByName(targets.filter(~wide)), f"targets-{n}")

    one = targets.filter("lo = hi").select(*group, "part", "side", F.col("lo").alias("v"))
    few = targets.filter("lo < hi")
    left = null_safe(values, few.select(*span).distinct(), group).filter("v between lo and hi").groupBy(*span).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    picked = null_safe(few, left, span).select(*group, "part", "side", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v"))
    ends = one.unionByName(picked).groupBy(*group, "part").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    shown = ends.withColumn("v", F.col("a") + F.col("part") * (F.col("b") - F.col("a")))
    return shown.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in wanted])
