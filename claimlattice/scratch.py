"""Intermediate tables of a query in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import shared_root


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder of its own; it goes when the program ends."""
    folder = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def drop():
        with contextlib.suppress(Exception):
            if not spark._jsc.sc().isStopped():
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(drop)
    return folder


def saver(spark: SparkSession, label: str):
    """``save(frame, name)``: writes and rereads, so that a lost executor costs a re-read only."""
    folder = scratch_folder(spark, label)

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return save
