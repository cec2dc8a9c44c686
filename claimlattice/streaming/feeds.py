"""Streaming operators.  Event time must be a timestamp: NTZ columns are cast first."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_root

def shared_folder(spark: SparkSession) -> str:
    """A folder of its own for one stream; it goes when the program ends."""
    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"

    def drop():
        with contextlib.suppress(Exception):
            if not spark._jsc.sc().isStopped():
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(drop)
    return folder


def event_stream(spark: SparkSession, path: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A table's files as a stream with a watermark on ``at``; ``path`` is a folder or one file."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        # A file source reads folders: the one file is picked by name.
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table of the shared folder."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed(events: DataFrame, length: str, slide: str | None = None, *keys: str) -> DataFrame:
    by = events.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), *keys)
    return by.agg(F.count(F.lit(1)).alias("n")).select("window", *keys, "n")


def bursts(events: DataFrame, length: str, at_least: int, *keys: str) -> DataFrame:
    """Windows in which a key (say, a cluster of alike posts) comes up often."""
    return windowed(events, length, None, *keys).filter(F.col("n") >= at_least)


def alerts(events: DataFrame, watches: DataFrame, key: str) -> DataFrame:
    """Stream-static join: events of interest with who watches them (small or large: the planner checks)."""
    return events.join(watches, key)


def gated_alerts(filings: DataFrame, watches: DataFrame, preferences: DataFrame, key: str, member: str) -> DataFrame:
    """Alerts only for members whose ``preferences(member, enabled)`` has them on; without a row they are off."""
    return alerts(filings, watches, key).join(preferences.filter("enabled").select(member), member)


class RunningCount(StatefulProcessor):
    """Per key: events so far, the sum of their values and the latest time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("running", "n long, total double, latest timestamp")

    def handleInputRows(self, key, rows, timer_values):
        n, total, latest = self.state.get() if self.state.exists() else (0, 0.0, None)
        for pdf in rows:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
            newest = pdf["ts"].max().to_pydatetime()
            latest = newest if latest is None else max(latest, newest)
        self.state.update((n, total, latest))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy("user_id").transformWithStateInPandas(RunningCount(), "user_id long, n long, total double", "Update", "None")
