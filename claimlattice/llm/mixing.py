"""Mixing sources to target weights by entropy balancing [native].

Every document gets a rate r in [0, max_copies]; the rates nearest to 1 in
Kullback-Leibler divergence, such that the words of each source meet its
target, are ``min(max_copies, exp(l * size / mean size))`` with one dual value
l per source.  Distributed Newton iterations solve the (concave) dual for all
sources at once.  Rates depend only on source and size, so the iterations run
on the counts by (source, size), which is exact and far smaller than the
documents.  Rates then become whole copies by systematic rounding: copies
follow the running sum of rates over (size descending), so the words of a
source stray from its target by about the gaps between neighbouring sizes.

Everything is DataFrame expressions: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 40


def running(ws: Workspace, df: DataFrame, order: list, sums: dict, name: str) -> DataFrame:
    """``df`` plus ``place`` (from 0) in the order given and the sums of all rows before each, by range partitions.

    Only one row a partition meets in a window of its own.
    """
    parts = ws.save(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"place": F.lit(1)} | sums
    whole = parts.groupBy("part").agg(*[F.sum(x).alias(f"of_{k}") for k, x in sums.items()])
    whole = whole.select(F.col("part").alias("at_part"), *[F.coalesce(F.sum(f"of_{k}").over(before), F.lit(0)).alias(f"to_{k}") for k in sums])
    rows = parts.withColumns({f"in_{k}": F.coalesce(F.sum(x).over(own), F.lit(0)) for k, x in sums.items()}).join(whole, F.col("part") == F.col("at_part"))
    return rows.select(*df.columns, *[(F.col(f"in_{k}") + F.col(f"to_{k}")).alias(k) for k in sums])


def targets(ws: Workspace, sources: DataFrame, weights, share: float, most: float) -> DataFrame:
    """``sources(source, source_size)`` plus ``target``: water-filling under caps.

    Sources in order of code point, null last, take the weights in turn.  A
    target stops at ``most`` times its source's size; the excess is reshared
    by weight until none is above, which is to say: one level L for all, and
    target = min(cap, L * weight).
    """
    n = len(weights)
    w = running(ws, sources, [F.col("source").asc_nulls_last()], {}, "sources")
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % n + 1).cast("int"))).drop("place")
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fills_at", F.col("cap") / F.col("weight"))
    w = ws.save(running(ws, w, [F.col("fills_at"), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weights": F.col("weight")}, "by-level"), "levels")
    budget, weights_ = w.agg(F.sum("source_size") * F.lit(float(share)), F.sum("weight")).first()
    # If the sources that fill earlier are full, this is the level of the others.
    level = (F.lit(budget) - F.col("caps")) / (F.lit(weights_) - F.col("weights"))
    at = w.withColumn("level", level).agg(F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level")))).first()[0]
    return w.select("source", "source_size", F.coalesce(F.least("cap", F.lit(at).cast("double") * F.col("weight")), F.col("cap")).alias("target"))


def same(a, b):
    return F.col(a).eqNullSafe(F.col(b))


def solve(ws: Workspace, counts: DataFrame, goals: DataFrame, most: float, rounds: int = ROUNDS, close: float = 1e-8) -> DataFrame:
    """``source, source_size, target, mean, dual``; ``dual`` is null where the target is 0 or the cap.

    ``counts(source, size, n)``.  Newton steps on f(l) = sum n*size*rate - target,
    which grows with l, kept inside a bracket that each step narrows.
    """
    mean = counts.filter("size > 0").groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s"), F.sum("n").alias("k"))
    mean = mean.select(F.col("source").alias("src"), (F.col("s") / F.col("k")).alias("mean"))
    state = goals.join(mean, same("source", "src"), "left").drop("src")
    inner = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most)
    state = ws.save(state.select("*", inner.alias("inner")), "dual-start")
    fixed = state.filter("not inner").select("source", "source_size", "target", "mean", F.lit(None).cast("double").alias("dual"))
    held = ["source", "source_size", "target", "mean", "dual", "low", "high"]
    start = F.log(F.col("target") / F.col("source_size"))  # exact if all sizes were equal
    state = state.filter("inner").select(*held[:4], start.alias("dual"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"))
    counts = counts.filter("size > 0").withColumnRenamed("source", "src")
    for i in range(1, rounds + 1):
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.col("dual") * z)
        words = F.col("n") * F.col("size")
        step = counts.join(state, same("src", "source")).groupBy(*held).agg(
            (F.sum(words * F.least(rate, F.lit(float(most)))) - F.col("target")).alias("gap"),
            F.sum(F.when(rate < most, words * rate * z).otherwise(0.0)).alias("slope"),
        )
        gap, done = F.col("gap"), F.abs("gap") <= F.col("target") * close
        step = step.withColumn("low", F.when(gap < 0, F.col("dual")).otherwise(F.col("low")))
        step = step.withColumn("high", F.when(gap > 0, F.col("dual")).otherwise(F.col("high")))
        newton = F.col("dual") - F.try_divide("gap", "slope")
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        moved = F.when(done, F.col("dual")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = ws.save(step.select(*held[:4], moved.alias("dual"), *held[5:], done.alias("done")), f"dual-{i}")
        settled = state.agg(F.min("done")).first()[0]
        state = state.drop("done")
        if settled is not False:
            break
    return fixed.unionByName(state.select(*held[:5]))


def mix(spark: SparkSession, docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, with_rows: bool = True, ws: Workspace | None = None) -> DataFrame:
    """``docs`` plus ``size, source_size, target, rate, copies, taken``.

    ``with_rows=False`` leaves out all columns of ``docs`` but doc_id and source.

    Columns of these names in the input are replaced.  Null or wordless texts
    have size 0, rate 0 and no copy; null sources form one source, the last;
    sizes of nothing but 0 give targets of 0.  Rows of one source and size
    differ by at most one copy; those up to some hash of doc_id get the extra
    one, so reruns agree and rows that repeat a doc_id go together.  Very long
    texts count whole; an empty table gives no row.

    A hot source or size is no hot task: counts are pre-aggregated, rows are
    ranked within one hash bucket of a (source, size) only, and the join with
    the decisions can be split.
    """
    ws = ws or Workspace(spark, "mixing")
    most_copies = int(most)
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    keep = [c for c in docs.columns if c not in added]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.xxhash64("doc_id", F.lit(17))
    # Buckets cut the range of the hash, so they stand in its order.
    sized = docs.select("doc_id", "source", size.alias("size"), order.alias("h"), F.shiftright(order, 58).cast("int").alias("bucket"))
    sized = ws.save(sized, "sized")

    by_bucket = ws.save(sized.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "by-bucket")
    counts = ws.save(by_bucket.groupBy("source", "size").agg(F.sum("n").alias("n")), "counts")
    sources = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    goals = ws.save(targets(ws, sources, weights, share, most), "goals")
    duals = solve(ws, counts, goals, most)

    # Copies of each (source, size) class: differences of the rounded running sum of rates.
    d = duals.withColumnRenamed("source", "src")
    rate = (
        F.when(F.col("size") == 0, 0.0)
        .when(F.col("dual").isNotNull(), F.least(F.exp(F.col("dual") * F.col("size") / F.col("mean")), F.lit(float(most))))
        .when(F.col("target") > 0, float(most))
        .otherwise(0.0)
    )
    classes = counts.join(d, same("source", "src")).drop("src").withColumn("rate", rate)
    run = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(run) + 0.5)
    classes = classes.withColumn("upto", upto)
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy(F.col("size").desc())), F.lit(0))
    classes = classes.withColumn("k", F.least(F.col("upto") - before, F.col("n") * most_copies)).drop("upto")
    classes = ws.save(classes.withColumn("each", F.floor(F.col("k") / F.col("n"))).withColumn("extra", F.col("k") - F.col("each") * F.col("n")), "classes")

    # The hash up to which a class's rows get the extra copy: ranked in one bucket only.
    offset = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    turn = by_bucket.withColumn("skip", F.coalesce(F.sum("n").over(offset), F.lit(0))).withColumnsRenamed({"source": "src", "size": "sz"})
    turn = turn.join(classes.select("source", "size", "extra"), same("source", "src") & (F.col("size") == F.col("sz")))
    turn = turn.filter("skip < extra and extra <= skip + n").select("src", "sz", F.col("bucket").alias("bk"), (F.col("extra") - F.col("skip")).alias("nth"))
    turn = ws.save(turn, "turn")
    ranked = sized.join(turn, same("source", "src") & (F.col("size") == F.col("sz")) & (F.col("bucket") == F.col("bk")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h")))
    upto = ranked.filter("rank = nth").select("src", "sz", F.col("h").alias("upto"))
    c = classes.withColumnsRenamed({"source": "c_source", "size": "c_size"}).join(upto, same("c_source", "src") & (F.col("c_size") == F.col("sz")), "left")
    c = ws.save(c.select("c_source", "c_size", "source_size", "target", "rate", "each", "upto"), "decided")

    rows = docs.select(*keep, size.alias("size"), order.alias("h")) if with_rows else sized
    mixed = rows.join(c, same("source", "c_source") & (F.col("size") == F.col("c_size")))
    mixed = mixed.withColumn("copies", F.col("each") + F.coalesce(F.col("h") <= F.col("upto"), F.lit(False)).cast("long"))
    mixed = mixed.withColumn("taken", F.col("copies") * F.col("size"))
    return mixed.select(*(keep if with_rows else ["doc_id", "source"]), *added)
