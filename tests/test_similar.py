"""Clusters of similar posts: what they take of disk, and that sketches, families and tiles lose no link."""

import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from claimlattice.streaming import similar
from claimlattice.streaming.similar import SimilarPosts


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").withColumn("at", F.timestamp_seconds(F.col("id") * 60)).coalesce(2)


def _family(rng, n, words, changed):
    """Texts that come from one, each with some words of its own."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(changed)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(text)


def _brute(texts, least=0.8):
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in texts if t and t.split()}
    cluster = {i: i for i in sets}

    def top(i):
        while cluster[i] != i:
            i = cluster[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                cluster[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def _shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    time.sleep(1)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_disk_grows_with_texts_and_not_with_pairs(spark, tmp_path):
    rng = random.Random(8)
    # As with tables that are too large to be sent to all.
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    texts = list(enumerate(_family(rng, 240, 300, 30)))
    size, before = sum(len(t) for _, t in texts), _shuffled(spark)
    state = SimilarPosts(spark, str(tmp_path))
    try:
        for n in range(2):
            state.add(_frame(spark, texts[n * 120 : n * 120 + 120]), n)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    taken = _shuffled(spark) - before + _bytes(tmp_path)
    # 15 times the texts when every pair that met took its two sets along.
    assert taken < 4 * size, (taken, size)
    assert {r["id"]: r["cluster"] for r in state.clusters().collect()} == _brute(texts)


def test_tiles_lose_no_link(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [t for n, words, changed in ((30, 80, 9), (20, 200, 30), (12, 40, 6), (9, 12, 2)) for t in _family(rng, n, words, changed)]
    texts = list(enumerate(texts + ["one two", "one two", "alone"]))
    rng.shuffle(texts)
    monkeypatch.setattr(similar, "SKETCHED", 500)
    monkeypatch.setattr(similar, "WRITTEN", 2000)
    state = SimilarPosts(spark, str(tmp_path))
    for n in range(2):
        state.add(_frame(spark, texts[n::2]), n)
    assert {r["id"]: r["cluster"] for r in state.clusters().collect()} == _brute(texts)


def test_ids_that_repeat_and_batches_that_broke_off(spark, tmp_path):
    a, b, c = "a b c d e f g h", "b c d e f g h i j k", "k l m n o p"
    state = SimilarPosts(spark, str(tmp_path))
    # Of 2 the null text is the least, so the id is still free; a set that no id holds joins nothing.
    state.add(_frame(spark, [(1, b), (1, a), (2, None), (2, a), (3, c), (3, c)]), 0)
    rows = _frame(spark, [(1, c), (2, b), (4, a), (5, c)])

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    kept, state.members.put = state.members.put, stop
    try:
        state.add(rows, 1)
    except Stop:
        state.members.put = kept
    state.add(rows, 1)
    state.add(rows, 1)
    assert {r["id"]: r["cluster"] for r in state.clusters().collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 3}


def test_sketches_are_not_further_apart_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 70, 1000, 4000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for kept in (0.5, 0.8, 0.95, 1.0):
            y = np.unique(np.concatenate((x[: int(n * kept)], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64))))
            if len(y):
                sketches = similar._Sketches([similar.sketch_of(s) for s in (np.unique(x), y)])
                if len(np.unique(sketches.length)) == 1 or max(sketches.length) == 2 * min(sketches.length):
                    assert sketches.apart(0, np.array([1]))[0] <= len(np.setxor1d(x, y))
