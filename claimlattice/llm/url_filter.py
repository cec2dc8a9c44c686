"""URL filters: allow and block rules on host and path prefixes [native].

Method: sort-merge range join.  A rule (host, path) becomes, on the key
(reversed host, path), the interval of all paths that start with the rule's.
A url stands under each of its enclosing hosts (``com``, ``com.example``, ...),
so subdomains fall into the same intervals.  Interval ends and url keys are
range-partitioned and sorted together and swept once: a stack of the rules
that are open gives, behind every interval end, the innermost open rule, and
each url takes the one at the last end before it.  Only distinct (host, path)
are swept; the verdicts are joined back, which adaptive execution can split.

Everything is DataFrame expressions: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the ``op10_url_filter`` query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def split_url(url):
    """(host, path) columns of a url column; both empty for null or no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host):
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def enclosing(host):
    """Reversed keys of a host and of every host above it."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))


def interval_ends(rules: DataFrame) -> DataFrame:
    """``under, at, past, top`` rows: behind key (under, at, past) rule ``top`` is innermost, or none.

    Rules of one host nest by path.  Their ends, in order, drive a stack: a
    start pushes its rule, an end pops it.  The stack's height is a running
    sum, and what lies on top at height d is the last start that reached d.
    ``past`` is 0 at a start and 2 at an end, so urls (1) that start with
    ``at`` lie between the two.
    """
    top = F.max_by(F.struct("verdict", "host", "path"), F.when(F.col("verdict") == "block", 1).otherwise(0))
    rules = rules.groupBy(reversed_host(F.col("host")).alias("under"), F.col("path").cast("binary").alias("at")).agg(top.alias("rule"))
    ends = F.array(
        F.struct(F.col("at"), F.lit(0).alias("past")),
        # No UTF-8 text holds the byte FF, so at + FF lies behind all that start with at.
        F.struct(F.concat("at", F.unhex(F.lit("FF"))).alias("at"), F.lit(2).alias("past")),
    )
    events = rules.select("under", "rule", F.explode(ends).alias("e")).select("under", "e.at", "e.past", "rule")
    order = Window.partitionBy("under").orderBy("at", "past")
    events = events.withColumn("height", F.sum(1 - F.col("past")).over(order))
    opened = F.last(F.when(F.col("past") == 0, F.col("rule")), ignorenulls=True).over(Window.partitionBy("under", "height").orderBy("at", "past"))
    return events.select("under", "at", "past", F.when(F.col("height") > 0, opened).alias("top"))


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow", ws: Workspace | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (other columns stay; clashing ones are replaced).

    The longest rule that fits wins (host plus path; ties: the longer host).
    Two verdicts for one rule: block.  No rule: ``default``.  Null urls, urls
    without ``://`` and empty ones have empty host and path and fit no rule;
    repeated rows each get their verdict; empty tables give empty results.
    Very long urls are keys like others.
    """
    ws = ws or Workspace(spark, "url-filter")
    host, path = split_url(F.col("url"))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    named = pages.select(*keep, host.alias("host"), path.alias("path"))
    rules = rules.select(
        "verdict", F.translate("host", UPPER, LOWER).alias("host"), "path"
    ).filter("verdict is not null and host is not null and path is not null")
    ends = ws.save(interval_ends(rules), "ends")

    keys = named.select("host", "path").distinct().filter("host <> ''")
    keys = keys.select("host", "path", F.explode(enclosing(F.col("host"))).alias("under"))
    events = keys.select("under", F.col("path").cast("binary").alias("at"), F.lit(1).alias("past"), "host", "path", F.lit(None).cast(ends.schema["top"].dataType).alias("top")).unionByName(
        ends.select("under", "at", "past", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "top")
    )
    # host last: urls under one (under, path) may be dealt to several ranges.
    events = events.repartitionByRange("under", "at", "past", "host").withColumn("part", F.spark_partition_id())
    events = ws.save(events, "events")

    # What is open where a part begins: the last end of the parts before.  One row a part.
    of_end = lambda *c: F.when(F.col("past") != 1, F.struct(*c))
    lasts = events.groupBy("part").agg(F.max_by(of_end("under", "top"), of_end("under", "at", "past")).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opened = lasts.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))

    sweep = Window.partitionBy("part").orderBy("under", "at", "past").rangeBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("past") != 1, F.struct("under", "top")), ignorenulls=True).over(sweep)
    swept = events.withColumn("last", last).filter("past = 1").join(opened, "part", "left")
    swept = swept.withColumn("last", F.coalesce("last", "carried")).filter("last.under = under and last.top is not null")
    best = swept.groupBy("host", "path").agg(
        F.max_by(
            "last.top",
            F.struct(
                (F.length("last.top.host") + F.length("last.top.path")).alias("long"),
                F.length("last.top.host").alias("host_long"),
            ),
        ).alias("top")
    )
    best = ws.save(best.select("host", "path", F.concat("top.host", "top.path").alias("rule"), "top.verdict"), "best")
    judged = named.join(best, ["host", "path"], "left")
    return judged.select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")
