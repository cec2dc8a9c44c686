"""Several micro-batches, late rows and a far row that closes the last windows."""

import os

from pyspark.sql import functions as F

from claimlattice.plans import streams
from claimlattice.streaming.feeds import drained, windowed


def test_late_rows_and_closing(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in os.listdir(tmp_path / "in"):
            if f.startswith("part") and not f.startswith("part-seen"):
                os.utime(tmp_path / "in" / f, (n, n))
                os.rename(tmp_path / "in" / f, tmp_path / "in" / f"part-seen-{n}-{f[5:13]}.parquet")

    put(1_700_000_000, [(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:50:00")])
    put(1_700_000_100, [(1, "2024-01-01 05:00:00")])
    # Late rows are told by the watermark of the batch before the last.
    put(1_700_000_150, [(1, "2024-01-01 05:10:00")])
    put(1_700_000_200, [(1, "2024-01-01 00:20:00")])
    put(1_700_000_300, [(1, "2030-01-01 00:00:00")])
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    got = {str(r["window"]["start"]): r["n"] for r in drained(windowed(stream, "1 hour")).collect()}
    assert got == {"2024-01-01 00:00:00": 2, "2024-01-01 05:00:00": 2}


def test_landings_are_written_by_many_tasks(spark):
    """Four micro-batches in order of time, each of several files, though a landing's rows stand in few of the table's tasks."""
    rows = spark.range(0, 4000, 1, 16).select("id", F.timestamp_seconds("id").alias("at"))
    seen = {}

    def look(batch, n):
        found = batch.select("id", F.input_file_name().alias("file")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files")).first()
        seen[n] = (found["lo"], found["hi"], found["n"], found["files"])

    for frame in (rows, rows.filter("id < 3")):
        seen.clear()
        stream = streams._landed(frame, "at")
        stream.writeStream.foreachBatch(look).option("checkpointLocation", f"{streams.shared_folder(spark)}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        if frame is rows:
            assert [seen[n][:3] for n in sorted(seen)] == [(i * 1000, i * 1000 + 999, 1000) for i in range(4)]
            assert all(s[3] == 4 for s in seen.values())
        else:
            assert len(seen) == 4 and [s[0] for _, s in sorted(seen.items()) if s[2]] == [0, 1, 2]
