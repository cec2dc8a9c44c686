"""Overview, per-source counts, bursts, trends, recency, sessions, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.user import register, skewness
from ..operators.intervals import overlapping
from ..operators.matching import as_of
from ..scratch import saver
from ..session import table
from . import query

SHOWN = "yyyy-MM-dd HH:mm:ss"


@query("""SELECT CAST(round(avg(value), 2) AS DOUBLE) AS avg_value, count(*) AS n_today, count(*) FILTER (event_type = 'error') AS n_high, count(*) FILTER (event_type = 'purchase') AS n_official
    FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events)""")
def platform_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    today = events.agg(F.max("ts").cast("date").alias("today"))
    on = events.join(today, F.col("ts").cast("date") == F.col("today"))
    return on.agg(
        F.round(F.avg("value"), 2).alias("avg_value"), F.count(F.lit(1)).alias("n_today"), F.count_if(F.col("event_type") == "error").alias("n_high"), F.count_if(F.col("event_type") == "purchase").alias("n_official")
    )


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def hits_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def hits_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs FROM documents")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"))


@query()
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.approx_count_distinct("text", 0.02).alias("n_texts"), F.hll_sketch_estimate(F.hll_sketch_agg("doc_id")).alias("n_ids"))


@query("""SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 3""")
def burst_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3600 * 1_000_000, 0)
    return table(spark, sf_dir, "events").withColumn("n", F.count(F.lit(1)).over(recent)).filter("n >= 3").select("event_id", "n")


@query("""SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", SHOWN).alias("hour"), "event_type", "n", "total")


@query("""SELECT event_id, round(value - lag(value) OVER w, 4) AS change, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS trend
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def risk_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    change = F.round(F.col("value") - F.lag("value").over(w), 4)
    return table(spark, sf_dir, "events").select("event_id", change.alias("change"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 4).alias("trend"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return latest.select("event_id", F.date_format("ts", SHOWN).alias("at"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT e.event_id, c.c_custkey, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'error' AND c.c_acctbal > 0")
def watch_alerts_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    risky = table(spark, sf_dir, "events").filter("event_type = 'error'")
    watching = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    return risky.join(watching, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_custkey", "c_name")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"))


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, (SELECT max_by(p.event_id, (p.ts, p.event_id)) FROM p WHERE p.user_id = e.user_id AND p.ts <= e.ts) AS as_of_event_id FROM e""")
def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    errors, purchases = (events.filter(F.col("event_type") == t).select("event_id", "user_id", "ts") for t in ("error", "purchase"))
    return as_of(errors, purchases, "user_id", "ts", ["event_id"], "event_id", saver(spark, "as-of")).select("event_id", "as_of_event_id")


@query("""SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase'
    AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR""")
def interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets as wide as the interval make the range join an equi join: a row meets its own bucket and the next."""
    events = table(spark, sf_dir, "events").withColumn("bucket", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 7200))
    a = events.filter("event_type = 'view'").select(F.col("event_id").alias("first_id"), "user_id", F.col("ts").alias("from"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    b = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("second_id"), "user_id", "ts", "bucket")
    return a.join(b, ["user_id", "bucket"]).filter(F.col("ts").between(F.col("from"), F.col("from") + F.expr("INTERVAL 2 HOURS"))).select("first_id", "second_id")


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts, CAST(floor(abs(value)) AS BIGINT) AS minutes, CAST(json_extract(props, '$.k') AS BIGINT) AS hours FROM events)
    SELECT a.event_id AS claim_id, b.event_id AS filing_id, strftime(greatest(a.ts, b.ts), '%Y-%m-%d %H:%M:%S') AS since
    FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type IN ('view', 'click') AND b.event_type = 'purchase'
      AND a.ts <= b.ts + to_hours(b.hours) AND b.ts <= a.ts + to_minutes(a.minutes)""")
def claim_filing_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and the filings that are in force while they stand: both hold for as long as their row says."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").withColumn("at", micros)
    a = events.filter("event_type in ('view', 'click')")
    a = a.select("user_id", F.col("event_id").alias("claim_id"), F.col("at").alias("a_start"), (F.col("at") + F.floor(F.abs("value")) * 60_000_000).alias("a_end"))
    b = events.filter("event_type = 'purchase'").withColumn("hours", F.from_json("props", "struct<k:long>")["k"])
    b = b.select("user_id", F.col("event_id").alias("filing_id"), F.col("at").alias("b_start"), (F.col("at") + F.col("hours") * 3_600_000_000).alias("b_end"))
    since = F.date_format(F.timestamp_micros(F.greatest("a_start", "b_start")), SHOWN)
    return overlapping(a, b, ["user_id"]).select("claim_id", "filing_id", since.alias("since"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
      s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n_events FROM s GROUP BY user_id, n""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("s"))
    return by.agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.date_format("s.start", SHOWN).alias("began"), "n_events")


@query("""WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def session_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a table function that says itself how its input is dealt and sorted."""
    register(spark)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = spark.sql("SELECT * FROM sessions(TABLE(SELECT * FROM {events}), gap => 7200000000)", events=events)
    return found.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "session")


@query("SELECT event_type, count(value) AS n, round(skewness(value), 5) AS skew FROM events GROUP BY event_type")
def value_skewness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skewness(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", F.round("skew", 5).alias("skew"))
