"""Client bindings, and announcements and records as pages show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import company_of, number_of, source_list, ticker_of
from ..operators import client, contract
from . import query

ANNOUNCEMENTS = (("2026-07-13", "台積電（2330）", "重大訊息"), ("2026-07-10", "甲公司（1234）", "財務報告"))
RECORDS = ((1, "2026-07-14 20:45", "X / Yahoo / MOPS", "42 分", "高風險"), (2, "2026-07-13 18:10", "X", "51 分", "中風險"), (3, "2026-07-12 11:30", "MOPS / Yahoo", "88 分", "低風險"))


@query("SELECT * FROM (VALUES (1, 'q'), (2, 'k1'), (3, '2330'), (4, '台積電下週保證漲停是真的嗎？'), (5, '台積電下週保證漲停是真的嗎？')) AS t(id, asked)")
def question_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "ai", " q ", None, None, None), (2, "text", "no", "k1", None, None), (3, "field", None, None, " ", "2330"), (4, "image", "no", None, None, None), (5, "voice", "", None, None, None)]
    asked = spark.createDataFrame(rows, "id int, mode string, question string, keywords string, company string, ticker string")
    asked = asked.withColumns({"news_url": F.lit(None).cast("string"), "post_url": F.lit(None).cast("string")})
    return client.extract_question(asked).select("id", "asked")


@query("""SELECT * FROM (VALUES (1, '查詢內容：「漲停？」', '高風險', 23, 3, '公開資訊觀測站 查詢結果|Yahoo 財經新聞 查詢結果|X 貼文 查詢結果|d'), (2, 'old', 'old', 0, 0, 'a|b|c|d'))
    AS t(id, query, level, score, kinds, sources)""")
def summary_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.createDataFrame([(1, '{"question":" 漲停？ "}'), (2, "")], "id int, body string")
    good = contract.responses(good).select("id", F.when(F.col("status") == 200, F.col("response")).alias("result"))
    slots = F.array(*map(F.lit, "abcd"))
    pages = good.select("id", "result", F.lit("old").alias("query"), F.lit("old").alias("level"), F.lit(0).alias("score"), F.lit(0).alias("kinds"), F.array(*map(F.lit, "xyz")).alias("reason_slots"), slots.alias("source_slots"))
    shown = client.bind_summary(pages)
    return shown.select(F.when(F.col("score") == 23, 1).otherwise(2).alias("id"), "query", "level", "score", "kinds", F.array_join("source_slots", "|").alias("sources"))


@query("SELECT * FROM (VALUES (200, CAST(NULL AS VARCHAR)), (400, '請輸入想查詢的金融資訊。'), (500, '分析失敗')) AS t(status, note)")
def status_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = spark.createDataFrame([('{"question":"x"}',), ("{}",), ("[1]",)], "body string")
    answered = contract.responses(bodies)
    error = F.when(F.col("status") == 400, F.get_json_object("response", "$.error"))
    return answered.select("status", client.outcome(F.col("status"), error).alias("note"))


@query("SELECT * FROM (VALUES ('2026-07-13', '台積電', '2330', '重大訊息'), ('2026-07-10', '甲公司', '1234', '財務報告')) AS t(ann_date, company, ticker, ann_type)")
def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame(list(ANNOUNCEMENTS), "date string, company string, ann_type string")
    return raw.select(F.to_date("date").cast("string").alias("ann_date"), company_of(F.col("company")).alias("company"), ticker_of(F.col("company")).alias("ticker"), "ann_type")


@query("""SELECT * FROM (VALUES (1, '2026-07-14 20:45:00', 'SOCIAL|NEWS|OFFICIAL', 42, -9), (2, '2026-07-13 18:10:00', 'SOCIAL', 51, -37), (3, '2026-07-12 11:30:00', 'OFFICIAL|NEWS', 88, NULL))
    AS t(id, analyzed_at, sources, score, change)""")
def history_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    raw = spark.createDataFrame(list(RECORDS), "id int, at string, sources string, score string, risk string")
    records = raw.select("id", F.to_timestamp("at", "yyyy-MM-dd HH:mm").alias("at"), source_list(F.col("sources")).alias("sources"), number_of(F.col("score")).alias("score"))
    change = F.col("score") - F.lag("score").over(Window.orderBy("at"))
    return records.select("id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("analyzed_at"), F.array_join("sources", "|").alias("sources"), "score", change.alias("change"))
