"""Contract, parsers, scores, matching and plans on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from claimlattice.functions import text as fn
from claimlattice.operators import contract, matching, scoring
from claimlattice.operators.search import Request, search
from claimlattice.plans.claims import BODIES

STRIPPED = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", "　"]
KEPT = ["﻿", "​"]


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_strip_is_pythons(spark):
    rows = [(c, f"{c}a{c}b{c}") for c in STRIPPED + KEPT]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "c string, t string").select("c", fn.strip(F.col("t"))).collect()}
    assert got == {c: t.strip() for c, t in rows}


def test_contract(spark):
    bodies = spark.createDataFrame([(i, b) for i, b, _, _ in BODIES] + [(99, None)], "id int, body string")
    got = {r["id"]: (r["question"], r["status"]) for r in contract.requests(bodies).collect()}
    assert got == {i: (q, s) for i, _, q, s in BODIES} | {99: ("", 400)}
    answers = {r["id"]: r["response"] for r in contract.responses(bodies).collect()}
    assert '"credibility_score":23' in answers[1] and contract.NO_QUESTION in answers[2]


def test_parsers(spark):
    r = one(spark, "c string, n string, s string, k string", ("台積電（2330）", "23%", "X / Yahoo / 其他", "a、b c,，a"), fn.company_of(F.col("c")), fn.ticker_of(F.col("c")), fn.number_of(F.col("n")), fn.source_list(F.col("s")), fn.keyword_list(F.col("k")))
    assert tuple(r) == ("台積電", "2330", 23, ["SOCIAL", "NEWS", "其他"], ["a", "b c"])
    r = one(spark, "c string, n string", ("無代號", "無"), fn.ticker_of(F.col("c")), fn.number_of(F.col("n")))
    assert tuple(r) == (None, None)
    r = one(spark, "a string, b string, c string", (" ", None, " x "), fn.first_filled(F.col("a"), F.col("b"), F.col("c")), fn.question_or_default(F.col("a")))
    assert tuple(r) == ("x", fn.DEFAULT_QUESTION)
    r = one(spark, "u string", ("HTTPS://A.Example.com/P?q#f",), fn.normal_url(F.col("u")), fn.url_host(F.col("u")))
    assert tuple(r) == ("https://a.example.com/P", "a.example.com")


@pytest.mark.parametrize("value, expected", [(23, "高風險"), (42, "高風險"), (51, "中風險"), (78, "中風險"), (88, "低風險")])
def test_levels(spark, value, expected):
    assert one(spark, "s int", (value,), scoring.level(F.col("s")))[0] == expected


def test_three_reasons_give_23(spark):
    fired = {"absolute": F.lit(True), "no_support": F.lit(True), "funnel": F.lit(True), "burst": F.lit(False)}
    assert one(spark, "x int", (1,), scoring.score(fired))[0] == 23


def test_lexicon(spark):
    text = F.col("t")
    fired = scoring.flags(text)
    r = one(spark, "t string", ("老師帶單，保證獲利，加入LINE 群組",), *[c.alias(n) for n, c in fired.items()])
    assert r.asDict() == {"absolute": True, "funnel": True, "insider": False, "urgency": False, "guru": True}


def test_phrase_hits_handle_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None), (3, ""), (4, "cd cd")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "cd"), (2, "cd"), (3, ""), (4, None), (5, "zz")], "item_id long, text string")
    got = sorted(tuple(r) for r in matching.phrase_hits(docs, phrases).collect())
    assert got == [(1, 1), (1, 2), (4, 1), (4, 2)]
    assert matching.phrase_hits(docs, phrases.limit(0)).count() == 0


def test_as_of_takes_equal_times_and_keeps_rows_without_match(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 5, 7), (1, 5, 8), (1, 2, 6), (3, 1, 1)], "k long, t long, v long")
    got = sorted((r["k"], r["t"], r["as_of_v"]) for r in matching.as_of(left, right, "k", "t", ["v"], "v").collect())
    assert got == [(1, 1, None), (1, 5, 8), (2, 9, None)]


def test_search_without_values_is_identity(spark):
    items = spark.createDataFrame([(1, "a", "s")], "id long, text string, source string")
    assert search(items, Request()).count() == 1


def test_filters_reach_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = search(docs, Request(sources=("src0",))).select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(source" in plan or "EqualTo(source" in plan
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    events = spark.read.parquet(f"{sf}/events.parquet")
    plan = search(events, Request(start=date(2024, 1, 2), end=date(2024, 1, 3)), at="ts").select("event_id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_session_gap_equal_to_timeout_stays(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 01:00:01")]
    df = spark.createDataFrame(rows, "u int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r[1] for r in df.groupBy("u", F.session_window("ts", "30 minutes")).count().select("u", "count").collect()) == [1, 2]
