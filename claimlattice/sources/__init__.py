"""Readers and writers of items, requests, history and feeds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_source

ITEM = "item_id bigint, source string, title string, body string, published_at timestamp, url string, company string, ticker string"
REQUEST = "mode string, question string, keywords array<string>, company string, ticker string, news_url string, post_url string, image_name string, start date, end date, sources array<string>, focus string"
RECORD = "analyzed_at timestamp_ntz, query string, sources array<string>, score int, risk_level string"


def read_items(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Posts, news or filings from any built-in format, with the columns of ITEM and canonical sources."""
    raw = spark.read.format(format).schema(ITEM).options(**options).load(path)
    return raw.withColumn("source", F.coalesce(canonical_source(F.col("source")), "source"))


def stream_items(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.format(format).schema(ITEM).options(**options).load(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One JSON body a line, kept as text: ``operators.contract`` parses it tolerantly."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def write_responses(responses: DataFrame, path: str) -> None:
    """The ``response`` column as lines of JSON."""
    responses.select(F.col("response").alias("value")).write.mode("overwrite").text(path)


def append_history(records: DataFrame, path: str) -> None:
    """Analysis records, partitioned by day so that date searches prune files."""
    records.withColumn("analysis_date", F.col("analyzed_at").cast("date")).write.mode("append").partitionBy("analysis_date").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RECORD}, analysis_date date").parquet(path)


def read_files(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """Uploaded images or audio as binary rows (path, modificationTime, length, content).

    ``extract`` (bytes -> text or null) is the hook for OCR or speech; its text
    becomes a column, worked out in Arrow batches.
    """
    files = spark.read.format("binaryFile").load(path)
    if extract is None:
        return files

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(extract)

    return files.withColumn("text", text("content"))


def put(entries: DataFrame, path: str) -> None:
    """Appends ``key, value, put_at`` entries to a key-value table."""
    entries.select("key", "value", "put_at").write.mode("append").parquet(path)


def get(spark: SparkSession, path: str) -> DataFrame:
    """``key, value``: the latest value of each key (of equal times the greatest value)."""
    entries = spark.read.schema("key string, value string, put_at timestamp_ntz").parquet(path)
    return entries.groupBy("key").agg(F.max_by("value", F.struct("put_at", "value")).alias("value"))
