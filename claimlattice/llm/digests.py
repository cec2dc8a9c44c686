"""SHA-256 of texts that are joined over many rows."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean


def joined_sha256(lines: DataFrame, keys: list[str], order: list[str], text: str, between: str) -> DataFrame:
    """``keys, sha256``: of each key's texts in ``order``, joined.

    The texts of a key stream through one task, as the digest needs them one
    after another; they are sorted with spilling and never held together.
    """
    types = {f.name: f.dataType.simpleString() for f in lines.schema}
    width = len(keys)

    @lean
    def run(batches):
        now, digest, schema = None, None, None
        for batch in batches:
            schema, done = batch.schema, []
            columns = [batch.column(i).to_pylist() for i in range(width)]
            for row, text in zip(zip(*columns), batch.column(width).to_pylist()):
                if digest is None or row != now:
                    if digest is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = row, hashlib.sha256()
                else:
                    digest.update(between.encode())
                digest.update(text.encode())
            if done:
                yield made(done, schema)
        if digest is not None:
            yield made([(*now, digest.hexdigest())], schema)

    def made(rows, schema):
        kinds = [*[schema.field(i).type for i in range(width)], pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*keys, "sha256"])

    dealt = lines.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, text)
    return dealt.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", sha256 string")
