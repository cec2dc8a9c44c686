"""Shared pieces: the shared work folder, table access, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset and Spark is local (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/claimlattice"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(docs: DataFrame) -> int:
    """Bytes of ``docs(text)``: Catalyst's estimate from file sizes, so no job runs;
    where it knows none (or multiplied some up), the texts are summed up."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def give_back() -> None:
    """Returns freed memory to the system: Python workers stay idle for a minute, and stages of several functions have many."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function over Arrow batches that gives memory back at its end."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(run):
    """The same for a function of a key and a table."""

    @functools.wraps(run)
    def task(key, table):
        try:
            return run(key, table)
        finally:
            give_back()

    return task


#: Rows in an Arrow batch where the session has Spark's default of 10,000: texts are long.
BATCH = 2000

#: Edges of a graph that one task of a components round handles.
EDGES_PER_TASK = 100_000


class Workspace:
    """Intermediate tables in the folder all executors share.

    A saved table cuts lineage: losing an executor costs a re-read, never a
    recomputation of the stages before it.
    """

    def __init__(self, spark: SparkSession, label: str):
        conf = spark.sparkContext.getConf()
        root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not conf.get("spark.master", "local").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = LOCAL_CHECKPOINTS
        self.spark = spark
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) in (None, "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        self.path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, parts: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """Writes and rereads a frame; ``parts`` merges what a shuffle has dealt out into so few tasks and files.

        ``by``: columns whose values become folders (``name/column=value``).
        """
        path = f"{self.path}/{name}"
        (df.coalesce(parts) if parts else df).write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes saved tables that no plan reads any more; without names, all."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            if self.spark._jsc.sc().isStopped():
                return
            self.drop()


def components(ws: Workspace, links: DataFrame, name: str = "cc", most_rounds: int = 50) -> DataFrame:
    """Connected components of undirected ``links(a long, b long)``.

    Alternates large-star and small-star rounds until the edges stand still.
    Returns ``node, component`` (smallest node reachable) for every node that
    has a link to another.  Minima are saved before they are joined back, so
    that adaptive execution may broadcast them or split a hot node's rows.
    """

    edges = ws.save(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        f"{name}-0",
    )
    total = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    before = tuple(edges.agg(F.count(F.lit(1)), total).first())
    for i in range(1, most_rounds + 1):
        # Rounds only ever join what stands; tasks follow the number of edges.
        parts = before[0] // EDGES_PER_TASK + 2

        def minima(edges, key, other, step):
            return ws.save(edges.groupBy(key).agg(F.min(other).alias("m")), step, parts)

        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        near = minima(both, "u", "v", f"{name}-{i}-large")
        large = ws.save(
            both.filter("v > u")
            .join(near, "u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
            .distinct(),
            f"{name}-{i}-mid",
            parts,
        )
        low = minima(large, "hi", "lo", f"{name}-{i}-small")
        joined = large.join(low, "hi")
        edges = ws.save(
            joined.select("hi", F.col("m").alias("lo"))
            .union(joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .distinct(),
            f"{name}-{i}",
            parts,
        )
        state = tuple(edges.agg(F.count(F.lit(1)), total).first())
        for step in ("large", "mid", "small"):
            ws.drop(f"{name}-{i}-{step}")
        ws.drop(f"{name}-{i - 1}")
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
