"""Sketches of each day kept as a table, merged for any range of days.

Counts of distinct keys (theta sketches, which also know intersections and
differences) and quantiles (KLL) of a range then cost a row for each day and
group, not the events of the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_sketches(events: DataFrame, day: Column, group: str, key: str, value: str) -> DataFrame:
    """``day, group, n, keys, quantiles``: nulls of key and value are in no sketch."""
    return events.groupBy(day.alias("day"), group).agg(
        F.count(F.lit(1)).alias("n"), F.theta_sketch_agg(key, F.lit(14)).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(400)).alias("quantiles")
    )


def merged(daily: DataFrame, first: str, last: str, group: str) -> DataFrame:
    """The sketches of the days from ``first`` to ``last``, both included, by group."""
    days = daily.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return days.groupBy(group).agg(F.sum("n").alias("n"), F.theta_union_agg("keys").alias("keys"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
