"""Streams over ``events``; in append mode windows that the watermark has not closed are not out yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming.feeds import alerts, bursts, drained, event_stream, gated_alerts, running, shared_folder, windowed
from ..streaming.ledger import CODEC, KeyedTable, written_once
from ..streaming.similar import SimilarPosts, follow
from ..streaming.timers import LateSplit, unanswered
from . import query

SHOWN = "yyyy-MM-dd HH:mm:ss"
SQL_SHOWN = "'%Y-%m-%d %H:%M:%S'"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, f"{sf_dir}/events.parquet")


@query(f"""SELECT strftime(w, {SQL_SHOWN}) AS hour, event_type, n FROM (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(windowed(_stream(spark, sf_dir), "6 hours", None, "event_type"))
    return out.select(F.date_format("window.start", SHOWN).alias("hour"), "event_type", "n")


@query(f"""SELECT strftime(w, {SQL_SHOWN}) AS hour, n FROM (
      SELECT w, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01'),
          time_bucket(INTERVAL '12 hours', ts - INTERVAL 6 HOUR, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR]) AS w FROM events) GROUP BY w)
    WHERE w + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(windowed(_stream(spark, sf_dir), "12 hours", "6 hours"))
    return out.select(F.date_format("window.start", SHOWN).alias("hour"), "n")


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
      s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, strftime(min(ts), {SQL_SHOWN}) AS began, count(*) AS n_events FROM s GROUP BY user_id, n
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _stream(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("s"))
    out = drained(by.agg(F.count(F.lit(1)).alias("n_events")))
    return out.select("user_id", F.date_format("s.start", SHOWN).alias("began"), "n_events")


@query("SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'error' AND c.c_acctbal > 0")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    watching = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    out = drained(alerts(_stream(spark, sf_dir).filter("event_type = 'error'"), watching, "user_id").select("event_id", "user_id"))
    return out.select("event_id", F.col("user_id").alias("c_custkey"))


@query(f"""SELECT strftime(w, {SQL_SHOWN}) AS day, user_id, n FROM (SELECT date_trunc('day', ts) AS w, user_id, count(*) AS n FROM events GROUP BY 1, 2)
    WHERE n >= 3 AND w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(bursts(_stream(spark, sf_dir), "1 day", 3, "user_id"))
    return out.select(F.date_format("window.start", SHOWN).alias("day"), "user_id", "n")


@query("""SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'purchase' AND c.c_mktsegment = 'BUILDING' AND c.c_acctbal > 0""")
def stream_gated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates go to members who watch them and have alerts on."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_acctbal")
    watches, preferences = customer.filter("c_mktsegment = 'BUILDING'").select("user_id"), customer.select("user_id", (F.col("c_acctbal") > 0).alias("enabled"))
    updates = _stream(spark, sf_dir).filter("event_type = 'purchase'")
    out = drained(gated_alerts(updates, watches, preferences, "user_id", "user_id").select("event_id", "user_id"))
    return out.select("event_id", F.col("user_id").alias("c_custkey"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch, so the state keeps every key until its end and the result is that of plain dedup."""
    return drained(_stream(spark, sf_dir).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"))


@query("""SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase'
    AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir)
    v = stream.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("seen"))
    p = _stream(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    joined = v.join(p, F.expr("viewer = user_id AND ts >= seen AND ts <= seen + INTERVAL 1 HOUR"))
    return drained(joined.select("view_id", "purchase_id"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of each key; the last (greatest n) is its state."""
    spark = spark.newSession()
    return _updates(running(_stream(spark, sf_dir))).groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"))


def _updates(stream: DataFrame) -> DataFrame:
    """Update mode has no file sink: each micro-batch overwrites the folder of its number, so a replayed one changes nothing."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    writer = stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


#: Files, and so micro-batches, that a table is dealt into.
LANDINGS = 4
#: Bytes of a row group of a landing: a micro-batch is read by many tasks also where its rows stand in few files.
GROUP = 4 << 20


def _landed(rows: DataFrame, at: str, parts: int = LANDINGS) -> DataFrame:
    """A table as a stream of several landings in order of time, one micro-batch each.

    Every task that reads the table writes its own file of a landing, so none
    reads or writes a landing alone, also if the table stands in order of time;
    empty files make up for tasks that had nothing to write.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    edges = rows.select(F.unix_micros(at).alias("t")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    step = ((edges["hi"] or 0) - (edges["lo"] or 0)) // parts + 1
    width = max(1, rows.rdd.getNumPartitions())
    rows.limit(0).coalesce(1).write.parquet(f"{folder}/blank")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    files = hadoop.Path(folder).getFileSystem(conf)
    written = lambda path: [f.getPath() for f in files.listStatus(hadoop.Path(path)) if f.getPath().getName().startswith("part-")]
    blank = written(f"{folder}/blank")[0]
    for i in range(parts):
        # One folder after another: a file source takes files by the time they were written.
        landing = f"{folder}/in/n{i}"
        rows.filter(F.floor((F.unix_micros(at) - (edges["lo"] or 0)) / step) == i).coalesce(width).write.option("compression", CODEC).option("parquet.block.size", GROUP).parquet(landing)
        for j in range(width - len(written(landing))):
            hadoop.FileUtil.copy(files, blank, files, hadoop.Path(f"{landing}/part-blank-{j}.parquet"), False, conf)
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", width).option("recursiveFileLookup", "true")
    return reader.parquet(f"{folder}/in")


@query("""SELECT DISTINCT user_id, event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day FROM events""")
def stream_daily_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert for each member, kind and day, whatever batches the events come in; the state of a day goes when the watermark has passed it."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    daily = _landed(events, "ts").withWatermark("ts", "1 hour").withColumn("window", F.window("ts", "1 day"))
    out = drained(daily.dropDuplicates(["user_id", "event_type", "window"]).select("user_id", "event_type", "window"))
    return out.select("user_id", "event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_keyed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals by key in a table that each micro-batch is put into once."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    totals = _landed(events, "ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    folder = shared_folder(spark)
    kept = KeyedTable(spark, f"{folder}/table", totals.schema, ["user_id"], compact_every=2)
    written_once(totals, kept, f"{folder}/checkpoint")
    return kept.get().select("user_id", "n", F.round("total", 2).alias("total"))


@query()
def stream_similar_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of alike documents that have three posts or more within ten hours; a document is posted at minute doc_id of 2024."""
    posted = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60)
    posts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", posted.alias("at"))
    folder = shared_folder(spark)
    state = SimilarPosts(spark, f"{folder}/state")
    follow(_landed(posts, "at"), state, f"{folder}/checkpoint")
    return state.bursts("10 hours", 3).select("cluster", F.date_format("window.start", SHOWN).alias("began"), "n")


@query("""WITH o AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT event_id, user_id FROM o WHERE ts + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
      AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = o.user_id AND p.ts BETWEEN o.ts AND o.ts + INTERVAL 6 HOUR)""")
def stream_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that no purchase of the member follows within six hours: event-time timers over several batches."""
    spark = spark.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = table(spark, sf_dir, "events").filter("event_type in ('error', 'purchase')").withColumn("ts", F.col("ts").cast("timestamp"))
    # The newest event of any kind moves the watermark.
    last = table(spark, sf_dir, "events").select(F.max(F.col("ts").cast("timestamp")).alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("event_type"))
    rows = events.select("ts", "event_id", "user_id", "event_type").unionByName(last)
    stream = _landed(rows, "ts").withWatermark("ts", "1 hour")
    cases = stream.select(F.coalesce("user_id", F.lit(-1)).alias("key"), F.coalesce("event_id", F.lit(-1)).alias("id"), "ts", (F.col("event_type") == "error").alias("opens"))
    return drained(unanswered(cases, 6 * 3600)).select(F.col("id").alias("event_id"), F.col("key").alias("user_id"))


@query("""WITH b AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS moved, CAST(floor((epoch_us(ts) - lo) / ((hi - lo) // 4 + 1)) AS BIGINT) AS part
      FROM events, (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)),
    p AS (SELECT event_id, ts, least(part + moved, 3) AS batch FROM b), w AS (SELECT batch, max(ts) AS newest FROM p GROUP BY batch)
    SELECT event_id, coalesce(ts < (SELECT max(newest) FROM w WHERE w.batch < p.batch) - INTERVAL 1 HOUR, false) AS late FROM p""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all events comes one batch later: what is late by more than an hour goes to an output of its own."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    edges = events.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).first()
    part = F.floor((F.unix_micros("ts") - (edges["lo"] or 0)) / (((edges["hi"] or 0) - (edges["lo"] or 0)) // LANDINGS + 1))
    batch = F.least(part + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0), F.lit(LANDINGS - 1))
    folder = shared_folder(spark)
    split = LateSplit(spark, folder, events.schema, ["event_id"], "ts", 3600)
    # The order of arrival is a time of its own.
    arrived = events.withColumn("arrival", F.timestamp_seconds(batch))
    writer = _landed(arrived, "arrival").writeStream.foreachBatch(lambda rows, n: split.add(rows.select("event_id", "ts"), n))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    one = lambda kept, late: kept.get().select("event_id", F.lit(late).alias("late"))
    return one(split.in_time, False).unionByName(one(split.late, True))
