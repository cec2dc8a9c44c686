"""Agreement by rare words against a plain loop."""

import math
import random
from collections import Counter

import duckdb
import pytest

from claimlattice.operators import terms
from claimlattice.plans import search

from .conftest import SF


def vectors(texts, idf=None):
    counts = {}
    for key, text in texts:
        counts.setdefault(key, Counter()).update((text or "").lower().split())
    if idf is None:
        df = Counter(t for c in counts.values() for t in c)
        idf = {t: math.log1p(len(counts) / n) for t, n in df.items()}
    weighed = {key: {t: n * idf[t] for t, n in c.items() if t in idf} for key, c in counts.items()}
    norms = {key: math.sqrt(sum(w * w for w in v.values())) for key, v in weighed.items()}
    return {key: {t: w / norms[key] for t, w in v.items()} for key, v in weighed.items()}, idf


def brute(queries, items, least, k):
    index, idf = vectors(items)
    out = []
    for q, v in vectors(queries, idf)[0].items():
        scores = [(round(sum(w * b.get(t, 0.0) for t, w in v.items()), 9), i) for i, b in index.items()]
        best = sorted((-s, i) for s, i in scores if s >= least)[:k]
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def agreeing(spark, queries, items, least, k):
    found = terms.agreeing(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least, k)
    return found.select("query_id", "item_id", "cosine", "rank")


def written(rng, n):
    """Few frequent words, many rare ones."""
    return " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    items = [(i, written(rng, rng.randrange(1, 40))) for i in range(60)] + [(60, None), (61, "")]
    queries = [(q, written(rng, rng.randrange(1, 90)).upper()) for q in range(80)]
    return [*queries, (80, None), (81, ""), (82, "unknown words"), (None, "w1 w2 w3"), (83, items[3][1]), (7, "w1 w2 w3"), (83, items[3][1])], items


@pytest.mark.parametrize("entries", [0, 100_000])
@pytest.mark.parametrize("least", [0.02, 0.3])
def test_agreeing_is_brute_force(spark, texts, monkeypatch, entries, least):
    monkeypatch.setattr(terms, "MOST_ENTRIES", entries, raising=False)
    monkeypatch.setattr(terms, "MOST_BYTES", 3000, raising=False)
    monkeypatch.setattr(terms, "MOST_MEETINGS", 2000, raising=False)
    got = sorted(map(tuple, agreeing(spark, *texts, least, 4).collect()))
    want = brute([q for q in texts[0] if q[0] is not None], texts[1], least, 4)
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
    assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(got, want))


def test_tasks_grow_with_the_meetings(spark, texts, monkeypatch):
    """No task sums for more queries when there are more of them."""
    monkeypatch.setattr(terms, "MOST_MEETINGS", 2000, raising=False)
    queries, items = texts
    tasks = [agreeing(spark, [(100 * n + (q or 0), t) for n in range(copies) for q, t in queries], items, 0.1, 3).rdd.getNumPartitions() for copies in (2, 8)]
    assert tasks[0] > 4 and tasks[1] > 3 * tasks[0]


def test_a_cosine_that_rounds_up_to_the_least(spark):
    rng = random.Random(9)
    while True:
        items, queries = [(1, written(rng, 30)), (2, "other")], [(1, written(rng, 20) + " other" * 40)]
        index, idf = vectors(items)
        asked = vectors(queries, idf)[0][1]
        cosine = sum(w * index[1].get(t, 0.0) for t, w in asked.items())
        least = round(cosine, 9)
        if 0.01 < least < 0.1 and 3e-10 < least - cosine < 4.5e-10:
            break
    assert (1, 1, 2) in [(r[0], r[1], r[3]) for r in agreeing(spark, queries, items, least, 2).collect()]


def test_cosines_are_rounded_as_in_sql(spark, monkeypatch):
    """Cosines that end in a half at the sixth digit."""
    values = [(n, (10 * n + 5) / 1e6) for n in range(10_000, 30_000)]
    found = spark.createDataFrame(values, "item_id long, cosine double").selectExpr("1L AS page_id", "item_id", "cosine", "1 AS rank")
    monkeypatch.setattr(search, "agreeing", lambda *_: found)
    got = {r["item_id"]: r["cosine"] for r in search.news_filing_agreement(spark, SF).collect()}
    want = duckdb.connect().execute("SELECT n, round((10 * n + 5) / 1e6::DOUBLE, 5) FROM range(10000, 30000) t(n)").fetchall()
    assert got == dict(want)
