"""The keyed table of streams, and clusters that do not depend on batches."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlattice.streaming.ledger import KeyedTable
from claimlattice.streaming.similar import SimilarPosts

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def test_puts_count_once_and_are_compacted(spark, tmp_path):
    kept = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], compact_every=3)
    assert kept.get().collect() == []
    for n in range(8):
        assert kept.put(spark.createDataFrame([(1, f"one{n}"), (n + 10, "x"), (None, f"none{n}")], SCHEMA).coalesce(1), n)
    # Replayed batches, with other rows, change nothing; compacted or not.
    assert not kept.put(spark.createDataFrame([(1, "replayed")], SCHEMA), 7)
    assert not kept.put(spark.createDataFrame([(1, "replayed")], SCHEMA), 2)
    got = {r["k"]: r["v"] for r in kept.get().collect()}
    assert got == {1: "one7", None: "none7"} | {n + 10: "x" for n in range(8)}
    assert len(kept._live()) <= 4


def test_a_put_that_broke_off_is_written_anew(spark, tmp_path):
    kept = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"])
    spark.createDataFrame([(1, "half")], SCHEMA).write.parquet(f"{tmp_path}/data/put-000000000000")
    assert kept.get().collect() == []
    assert kept.put(spark.createDataFrame([(2, "whole")], SCHEMA), 0)
    assert [tuple(r) for r in kept.get().collect()] == [(2, "whole")]


def test_clusters_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(24):
        text = list(bases[i % 4])
        if i % 3:
            text[rng.randrange(60)] = "other"
        texts.append((i, " ".join(text)))
    texts += [(50, None), (51, " "), (52, "short one")]
    rng.shuffle(texts)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in texts if t and t.split()}
    cluster = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    cluster[a] = cluster[b] = min(cluster[a], cluster[b])
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string").withColumn("at", F.timestamp_seconds(F.col("id") * 60)).coalesce(2)
    state = SimilarPosts(spark, str(tmp_path / "s"))
    for n, rows in enumerate((texts[:12], texts[12:])):
        state.add(frame(rows), n)
    state.add(frame(texts[:3]), 1)
    assert {r["id"]: r["cluster"] for r in state.clusters().collect()} == cluster
    counts = {r["cluster"]: r["n"] for r in state.bursts("1 day", 3).collect()}
    assert counts == {c: n for c in set(cluster.values()) if (n := list(cluster.values()).count(c)) >= 3}


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    from claimlattice.streaming.timers import LateSplit

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType())])
    rows = lambda *x: spark.createDataFrame([(i, s) for i, s in x], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    split = LateSplit(spark, str(tmp_path), schema, ["id"], "ts", 10)
    batches = [rows((1, 100), (2, 50), (3, None)), rows((4, 89), (5, 90), (6, 130)), rows((7, 119), (8, 500), (9, 120))]
    for n in (0, 1, 1, 2, 0, 2):
        split.add(batches[n], n)
    ids = lambda kept: sorted(r["id"] for r in kept.get().collect())
    assert (ids(split.in_time), ids(split.late)) == ([1, 2, 5, 6, 8, 9], [3, 4, 7])
