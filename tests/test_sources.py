"""Readers and writers, over files of several formats."""

import datetime

import pytest
from pyspark.sql import functions as F

from claimlattice import sources
from claimlattice.operators import client, contract, matching
from claimlattice.session import checkpoint_folder


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "orc"])
def test_items_of_any_format(spark, tmp_path, format):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(1, "X 貼文", "t", "b", at, "http://a/b", "台積電", "2330"), (2, "MOPS", None, "b2", at, None, None, None), (3, "elsewhere", "t", "b3", at, None, None, "1")]
    spark.createDataFrame(rows, sources.ITEM).write.format(format).option("header", False).save(str(tmp_path / "x"))
    got = sources.read_items(spark, str(tmp_path / "x"), format).orderBy("item_id").collect()
    assert [r["source"] for r in got] == ["SOCIAL", "OFFICIAL", "elsewhere"] and got[0]["ticker"] == "2330" and got[1]["title"] is None
    assert all(r["published_at"] == at for r in got)


def test_items_as_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "X", "t", "b", None, None, None, None)], sources.ITEM).write.parquet(str(tmp_path / "in"))
    stream = sources.stream_items(spark, str(tmp_path / "in"))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_requests_and_responses(spark, tmp_path):
    (tmp_path / "in.txt").write_text('{"question": " q "}\nnot json\n', encoding="utf-8")
    sources.write_responses(contract.responses(sources.read_requests(spark, str(tmp_path / "in.txt"))), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((r["success"], r["question"]) for r in back.select("success", "question").collect()) == [(False, None), (True, "q")]


def test_history_is_partitioned_by_day(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, d, 5), f"q{d}", ["SOCIAL"], d, "低風險") for d in (1, 2, 2, 3)]
    for part in (rows[:2], rows[2:]):
        sources.append_history(spark.createDataFrame(part, sources.RECORD), str(tmp_path / "h"))
    found = sources.read_history(spark, str(tmp_path / "h")).filter(F.col("analysis_date") == F.lit("2024-01-02").cast("date"))
    assert found.count() == 2 and "PartitionFilters: [isnotnull(analysis_date" in found._jdf.queryExecution().toString()


def test_keys_and_values(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    for part in ([("a", "1", at(1)), ("b", "x", at(1))], [("a", "2", at(3)), ("a", "0", at(2)), ("b", "y", at(1))]):
        sources.put(spark.createDataFrame(part, "key string, value string, put_at timestamp_ntz"), str(tmp_path / "kv"))
    assert {r["key"]: r["value"] for r in sources.get(spark, str(tmp_path / "kv")).collect()} == {"a": "2", "b": "y"}


def test_files_and_their_hook(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG 2330")
    (tmp_path / "b.png").write_bytes(b"x")
    assert sources.read_files(spark, str(tmp_path)).select("length").count() == 2
    found = sources.read_files(spark, str(tmp_path), lambda b: b[-4:].decode() if b[:4] == b"\x89PNG" else None)
    assert {r["length"]: r["text"] for r in found.collect()} == {9: "2330", 1: None}


def test_binding_leaves_few_slots_alone(spark):
    """Two metrics, one reason and no source slot: what does not fit drops."""
    page = spark.createDataFrame(
        [('{"question":"q"}', "old", "old", "old", "old", ["a", "b"], [("t", "d")], [])],
        "body string, query string, title string, status_tag string, overview string, metrics array<string>, reason_slots array<struct<title:string,description:string>>, source_slots array<struct<label:string,heading:string,description:string>>",
    )
    answered = contract.responses(page).withColumn("result", F.col("response")).drop("body", "response", "question", "status")
    r = client.bind_result(answered).first()
    assert r["metrics"] == ["a", "b"] and r["source_slots"] == [] and r["reason_slots"][0]["title"] == contract.REASONS[0] and r["title"] == contract.SUMMARY


def test_clusters_of_a_path_and_a_star(spark):
    checkpoint_folder(spark)
    links = [(i, i + 1) for i in range(12)] + [(100, i) for i in range(101, 110)] + [(7, 7)]
    got = {r["node"]: r["cluster"] for r in matching.clusters(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(13)} | {i: 100 for i in range(100, 110)}
