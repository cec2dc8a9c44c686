"""Phrases as rows: equal to plain search, whatever their lengths and shared openings."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimlattice.operators import matching, phrases
from claimlattice.session import table


def brute(docs, terms):
    return sorted((d, k) for d, t in docs for k, p in terms if t and p and p in t)


def hits(spark, docs, terms):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(terms, "item_id long, text string")
    return sorted(tuple(r) for r in matching.phrase_hits(d, p, most_bytes=0).collect())


def test_every_length_and_alphabet(spark):
    rng = random.Random(7)
    docs = [(i, "".join(rng.choices(rng.choice(["ab", "abcdefg ", "aé漢😀"]), k=rng.randint(1, 300)))) for i in range(150)]
    docs += [(200, None), (201, ""), docs[0], docs[0], (202, docs[0][1]), (203, "x" * 70 + docs[1][1] + "y" * 70)]
    terms = []
    for i in range(300):
        t = rng.choice(docs)[1] or "none"
        at = rng.randrange(len(t))
        terms.append((i, t[at : at + rng.choice([1, 2, 3, 5, 8, 15, 16, 31, 32, 33, 60, 300])]))
    terms += [(400, None), (401, ""), (402, "absent from all"), terms[0], (403, terms[0][1])]
    assert hits(spark, docs, terms) == brute(docs, terms)


def test_a_common_opening_brings_no_phrases_together(spark):
    """Of 400 phrases with one opening of 60 bytes, each text meets its own, not all."""
    head = "announcement of the board of the company in the matter of: "
    terms = [(i, f"{head}{i * 7919:09d} {i * 104729:012d}") for i in range(400)]
    docs = [(i, f"today {terms[i % 400][1]} and more") for i in range(800)]
    assert hits(spark, docs, terms) == brute(docs, terms)
    raw = spark.createDataFrame(terms, "id long, p string").selectExpr("cast(id as string) id", "p")
    marks = raw.mapInArrow(phrases._marks(None, None), "id string, anchor long")
    rare = marks.join(marks.groupBy("anchor").count(), "anchor").groupBy("id").agg(F.min("count").alias("n"))
    assert rare.filter("n > 3").count() == 0


def test_slabs_share_what_a_window_spans(monkeypatch):
    raw = np.random.default_rng(3).integers(97, 123, 5000, dtype=np.uint8).tobytes()
    whole = phrases.anchors(raw, phrases.TIERS)
    monkeypatch.setattr(phrases, "SLAB", 64)
    assert phrases.anchors(raw, phrases.TIERS).tolist() == whole.tolist()


def test_both_ways_agree_on_the_tables(spark, sf):
    docs, official = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    small = sorted(tuple(r) for r in matching.phrase_hits(docs, official).collect())
    assert small and small == sorted(tuple(r) for r in matching.phrase_hits(docs, official, most_bytes=0).collect())
    assert matching.phrase_hits(docs, official.limit(0), most_bytes=0).count() == 0


def test_texts_come_in_short_batches(spark, monkeypatch):
    """A task never holds more than a few hundred texts, however many its share has; nor do texts travel with their counts."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(held, key, phrase_key):
        return lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([0])], names=[key, phrase_key]) for b in batches)

    monkeypatch.setattr(matching, "_hits", sizes)
    docs = spark.range(3000).selectExpr("id as doc_id", "'some text' as text").coalesce(1)
    found = matching.phrase_hits(docs, spark.createDataFrame([(1, "text")], "item_id long, text string"))
    assert max(r["doc_id"] for r in found.collect()) <= 500
    counted = matching.copies(docs, keep_text=False)
    assert counted.columns == ["doc_id", "n_copies"] and counted.filter("n_copies <> 3000").count() == 0


def test_any_phrase_makes_no_pairs_with_short_ones(spark, monkeypatch):
    """Short phrases of all texts go no further than the automaton; longer ones are found by anchors."""
    rng = random.Random(11)
    long = [(100 + i, f"headline number {i} of the long kind, with more to say") for i in range(40)]
    short = [(i, "".join(rng.choices("abc", k=rng.randint(1, 3)))) for i in range(30)] + [(50, None), (51, "")]
    docs = [(i, "".join(rng.choices("xyz ", k=50)) + (rng.choice(short[:30])[1] if i % 3 == 0 else "") + (rng.choice(long)[1] if i % 5 == 0 else "")) for i in range(200)] + [(900, None), (901, "")]
    met = []
    real = matching.hits_by_anchor
    monkeypatch.setattr(matching, "hits_by_anchor", lambda d, p, *a: met.extend(r["p"] for r in p.collect()) or real(d, p, *a))
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(short + long, "item_id long, text string")
    for most, through in ((500, 40), (0, 40 + len({t for _, t in short if t})), (1 << 20, 0)):
        met.clear()
        got = matching.holding(d, p, most_bytes=most if most != 500 else sum(len(t) + 64 for t in {t for _, t in short if t}))
        assert {r["doc_id"] for r in got.collect()} == {i for i, _ in brute(docs, short + long)}
        assert len(met) == through
