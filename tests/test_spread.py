"""Operators that spread giant groups, against windows, loops and brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlattice.operators.intervals import overlapping
from claimlattice.operators.matching import as_of
from claimlattice.operators.ordered import range_of, ranked, tile
from claimlattice.operators.selection import quantiles
from claimlattice.scratch import saver


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows have key 1; values tie and some are null; rows repeat; a null key."""
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.5 else rng.choice([2, 3, None]), rng.choice([None, *range(6)]), rng.choice([0.0, -1e9, 1e300, rng.random()])) for _ in range(900)]
    return spark.createDataFrame(rows, "k int, v int, x double").repartition(5)


def counted(df):
    return sorted(map(str, df.collect()))


def test_ranked_is_the_window(spark, skewed):
    got = ranked(skewed, ["k"], ["v"], saver(spark, "test")).select("k", "v", "rank", "dense_rank", "group_size")
    w = Window.partitionBy("k")
    by = w.orderBy("v")
    want = skewed.select("k", "v", F.rank().over(by).cast("long").alias("rank"), F.dense_rank().over(by).cast("long").alias("dense_rank"), F.count(F.lit(1)).over(w).alias("group_size"))
    assert counted(got) == counted(want)


def test_ranked_spreads_a_key_and_one_value(spark):
    rows = spark.range(400).select(F.lit(1).alias("k"), F.lit(7).alias("v"))
    dealt = []
    save = saver(spark, "test")

    def seen(df, name):
        out = save(df, name)
        if name == "ranked":
            dealt.append(out.select(range_of().alias("r")).groupBy("r").count().collect())
        return out

    # So few rows would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(rows, ["k"], ["v"], seen).agg(F.min("rank"), F.max("rank"), F.max("dense_rank"), F.count_distinct("row_number")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(got) == (1, 1, 1, 400)
    assert len(dealt[0]) > 1 and max(r["count"] for r in dealt[0]) < 400


@pytest.mark.parametrize("n", [4, 1000])
def test_tile_is_ntile(spark, skewed, n):
    rows = skewed.groupBy("k", "v", "x").count()
    got = ranked(rows, ["k"], ["v", "x", "count"], saver(spark, "test")).select("k", "v", "x", tile(n).alias("t"))
    want = rows.select("k", "v", "x", F.ntile(n).over(Window.partitionBy("k").orderBy("v", "x", "count")).alias("t"))
    assert counted(got) == counted(want)


def test_quantiles_are_percentiles(spark, skewed):
    got = quantiles(skewed, ["k"], {"a": ("x", 0.5), "b": ("x", 0.93), "c": ("v", 0.0), "d": ("v", 1.0)}, saver(spark, "test"), bins=3, small=2)
    want = skewed.groupBy("k").agg(F.percentile("x", 0.5).alias("a"), F.percentile("x", 0.93).alias("b"), F.percentile("v", 0.0).alias("c"), F.percentile("v", 1.0).alias("d"))
    near = lambda df: sorted((str(r["k"]), *[f"{r[c]:.9g}" for c in "abcd"]) for r in df.collect())
    assert near(got) == near(want)


def test_quantiles_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (1, float("nan")), (2, 5.0), (2, float("inf"))], "k int, x double")
    assert [tuple(r) for r in quantiles(rows, ["k"], {"m": ("x", 0.5)}, saver(spark, "test")).collect()] == [(2, 5.0)]


def test_as_of_with_a_hot_key(spark):
    rng = random.Random(2)
    right = [(1 if rng.random() < 0.7 else 2, rng.randrange(500), i) for i in range(300)]
    left = [(rng.choice([1, 1, 2, 3]), rng.randrange(500), 1000 + i) for i in range(200)]
    got = as_of(spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, i int"), "k", "t", ["i"], "i", saver(spark, "test"))
    want = {(k, t, i): max(((u, j) for q, u, j in right if q == k and u <= t), default=(None, None))[1] for k, t, i in left}
    assert {(r["k"], r["t"], r["i"]): r["as_of_i"] for r in got.collect()} == want


def test_overlaps_of_any_length(spark):
    rng = random.Random(3)
    spans = lambda n: [(rng.choice([1, 1, 2]), (s := rng.randrange(-5000, 5000)), s + int(rng.choice([0, 1, 7, 300, 9000]) * rng.random()), i) for i in range(n)]
    a, b = spans(120), spans(120)
    odd = [(1, 5, 4, 900), (1, None, 3, 901), (None, 0, 9, 902)]
    frame = lambda rows, p: spark.createDataFrame(rows, f"k int, {p}_start long, {p}_end long, {p}_id int")
    got = overlapping(frame(a + odd, "a"), frame(b + odd, "b"), ["k"]).select("a_id", "b_id")
    want = [(i, j) for k, s, e, i in a for q, t, f, j in b if k == q and s <= f and t <= e]
    assert sorted(map(tuple, got.collect())) == sorted(want)
