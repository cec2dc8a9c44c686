"""A keyed table that a stream writes exactly once.

Each put is a folder of its own, named by the batch's number, and counts only
once its entry stands in the ledger; a batch that is replayed after a failure
finds its entry and changes nothing, one that failed half-way overwrites its
folder.  Every ``compact_every`` puts the newest row of each key is written to
one folder, from which the next reads go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts take a third less than with Spark's default.
CODEC = "zstd"


class KeyedTable:
    """Rows by key; of several puts of a key the one of the greatest batch holds."""

    def __init__(self, spark: SparkSession, folder: str, schema, keys: list[str], compact_every: int = 16):
        self.spark, self.folder, self.schema, self.keys, self.every = spark, folder.rstrip("/"), schema, keys, compact_every

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        where = self._path("ledger")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[tuple[int, str]]:
        """(batch, folder) of all puts and compactions, in order; a compaction follows the put that caused it."""
        files, where = self._files(), self._path("ledger")
        if not files.exists(where):
            return []
        names = [f.getPath().getName() for f in files.listStatus(where)]
        return sorted((int(n.split("-")[1]), n) for n in names if n.startswith(("put-", "whole-")))

    def _enter(self, name: str) -> None:
        """The entry is an empty file: it is there as a whole or not at all."""
        self._files().create(self._path("ledger", name), False).close()

    def has(self, batch: int) -> bool:
        done = [n for _, n in self.entries()]
        return f"put-{batch:012d}" in done or any(n.startswith("whole-") and int(n.split("-")[1]) >= batch for n in done)

    def put(self, rows: DataFrame, batch: int) -> bool:
        """Writes a batch's rows; False if the ledger has that batch already."""
        if self.has(batch):
            return False
        name = f"put-{batch:012d}"
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").option("compression", CODEC).parquet(f"{self.folder}/data/{name}")
        self._enter(name)
        if len(self._live()) > self.every:
            self.compact()
        return True

    def _live(self) -> list[tuple[int, str]]:
        """The last compaction and the puts after it."""
        entries = self.entries()
        whole = max((b for b, n in entries if n.startswith("whole-")), default=None)
        return [(b, n) for b, n in entries if whole is None or (n.startswith("whole-") and b == whole) or (n.startswith("put-") and b > whole)]

    def compact(self) -> None:
        live = self._live()
        if not live:
            return
        last = live[-1][0]
        name = f"whole-{last:012d}"
        self.get().write.mode("overwrite").option("compression", CODEC).parquet(f"{self.folder}/data/{name}")
        self._enter(name)
        # Readers of the state before this one may still run: what it replaced goes with the next compaction.
        for b, n in self.entries():
            if b < live[0][0]:
                self._files().delete(self._path("ledger", n), False)
                self._files().delete(self._path("data", n), True)

    def _nothing(self) -> DataFrame:
        """No rows, known as such to the optimizer: joins with them go from plans."""
        return self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]).limit(0)

    def get(self) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{n}").withColumn("_batch", F.lit(b)) for b, n in self._live()]
        if not parts:
            return self._nothing()
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        columns = [c for c in self.schema.fieldNames() if c not in self.keys]
        if not columns:
            return rows.select(*self.keys).distinct()
        newest = F.max_by(F.struct(*columns), "_batch").alias("_row")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_row.*").select(*self.schema.fieldNames())


class Log(KeyedTable):
    """Rows that no later put changes: they are written once, never shuffled or compacted, and read by column."""

    def __init__(self, spark: SparkSession, folder: str, schema):
        super().__init__(spark, folder, schema, [])

    def compact(self) -> None:
        pass

    def get(self, first: int = 0, last: int | None = None) -> DataFrame:
        """Rows of the batches from ``first`` to ``last``."""
        paths = [f"{self.folder}/data/{n}" for b, n in self.entries() if b >= first and (last is None or b <= last)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self._nothing()


def written_once(stream: DataFrame, table: KeyedTable, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over all that is there; each micro-batch is one put."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: table.put(rows, n))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
