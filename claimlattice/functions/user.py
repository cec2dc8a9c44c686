"""A table function with partitions and a schema of its own making, and an aggregate with partial states."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Sessions:
    """``sessions(TABLE t, gap => micros)``: rows ``key, id, at`` with ``session``, from 0, which goes up where the time since the row before is longer than the gap.

    The table is dealt by key and sorted by time and id, whatever the caller
    asks for; a null time begins the key's first session.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or [f.name for f in table.dataType.fields] != ["key", "id", "at"]:
            raise ValueError("sessions needs a table of key, id, at")
        schema = StructType([*table.dataType.fields[:2], StructField("session", LongType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("at"), OrderingColumn("id")])

    def __init__(self):
        self.last, self.session = None, 0

    def eval(self, row, gap: int):
        if self.last is not None and row["at"] - self.last > gap:
            self.session += 1
        self.last = row["at"]
        yield row["key"], row["id"], self.session


def register(spark: SparkSession) -> None:
    spark.udtf.register("sessions", F.udtf(Sessions))


_STATE = "n double, mean double, m2 double, m3 double"


def _merged(a, b):
    """Central moments of two sets together."""
    (n, x, p, r), (m, y, q, s) = a, b
    if not n or not m:
        return a if n else b
    t, d = n + m, y - x
    return t, x + d * m / t, p + q + d * d * n * m / t, r + s + d**3 * n * m * (n - m) / t**2 + 3 * d * (n * q - m * p) / t


def _partial(batches):
    """Of each task and key one state."""
    held: dict = {}
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        frame = pd.DataFrame({"k": batch.column(0).to_pandas(), "v": batch.column(1).to_numpy(zero_copy_only=False)})
        for k, v in frame.dropna(subset=["v"]).groupby("k", dropna=False)["v"]:
            v = v.to_numpy(float)
            d = v - v.mean()
            state = (float(len(v)), float(v.mean()), float((d**2).sum()), float((d**3).sum()))
            k = None if pd.isna(k) else k
            held[k] = _merged(held[k], state) if k in held else state
    if held:
        columns = [pa.array([x[i] for x in held.values()], pa.float64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), *columns], names=["key", "n", "mean", "m2", "m3"])


def skewness(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, skew``: sample skewness (as a population's with less than three values: null), by states that tasks merge.

    A grouped aggregate in Python sees a whole group at once; here it sees a
    row for each task.  Nulls do not count; a key of nulls only has no row.
    """

    @F.pandas_udf("array<double>")
    def merged(n: pd.Series, mean: pd.Series, m2: pd.Series, m3: pd.Series) -> list:
        state = (0.0, 0.0, 0.0, 0.0)
        for x in sorted(zip(n, mean, m2, m3)):
            state = _merged(state, x)
        n, _, m2, m3 = state
        skew = np.sqrt(n * (n - 1)) / (n - 2) * np.sqrt(n) * m3 / m2**1.5 if n > 2 and m2 > 0 else None
        return [n, skew]

    kind = rows.schema[key].dataType.simpleString()
    states = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).mapInArrow(_partial, f"key {kind}, {_STATE}")
    return states.groupBy("key").agg(merged("n", "mean", "m2", "m3").alias("x")).select(F.col("key").alias(key), F.get("x", 0).cast("long").alias("n"), F.get("x", 1).alias("skew"))
