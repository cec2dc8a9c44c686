"""Moving many small fixed-width records between tasks as a few binary rows.

A map task deals its records by key into parts and writes one row
``part, payload`` for each; a reduce task gets whole parts back as numpy
columns.  Payloads hold one column after the other, which also compresses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, lean

#: Bits of the filter in ``having``: 1 MB, whatever the number of ids.
FILTER_BITS = 1 << 23


def part_count(spark: SparkSession, df: DataFrame, part_bytes: int) -> int:
    """Parts for records as large in all as the input, each of about ``part_bytes``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // part_bytes))


def dealt(columns: list[np.ndarray], key: np.ndarray, parts: int) -> pa.RecordBatch:
    """Records dealt into parts by the high bits of their ``key`` (uint64), as rows ``part, payload``."""
    part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    columns = [c[order] for c in columns]
    full = np.flatnonzero(np.diff(bounds))
    payloads = [b"".join(c[bounds[p] : bounds[p + 1]].tobytes() for c in columns) for p in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(payloads, pa.binary())], names=["part", "payload"])


def gathered(payloads: list[bytes], dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    """The records of some payloads."""
    width = sum(np.dtype(t).itemsize for t in dtypes.values())
    columns: dict[str, list] = {name: [] for name in dtypes}
    for p in payloads:
        n, at = len(p) // width, 0
        for name, t in dtypes.items():
            columns[name].append(np.frombuffer(p, t, n, at))
            at += n * np.dtype(t).itemsize
    return {name: np.concatenate(c) if c else np.zeros(0, dtypes[name]) for name, c in columns.items()}


def having(docs: DataFrame, ids: DataFrame, key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs(key, text, *more)`` whose id may be among ``ids(key)``: a 1 MB bit filter.

    It spares a shuffle the texts that a later join would drop anyway.  False
    hits are dropped by that join; with very many ids all rows pass.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:
        bits[r["w"]] = r["bits"]

    @lean
    def kept(batches):
        for batch in batches:
            s = batch.column(n).to_numpy(zero_copy_only=False)
            hit = (bits[s >> 6] >> (s & 63)) & 1
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n]).filter(pa.array(hit.astype(bool)))

    kept_columns = docs.select(key, "text", *more)
    n, fields = len(kept_columns.columns), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_columns.schema)
    return docs.filter(F.col(key).isNotNull()).select(key, "text", *more, slot.alias("s")).mapInArrow(kept, fields)
