"""The analysis request contract: a JSON body in, a result or an error row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed values of the response contract.
NO_QUESTION = "請輸入想查詢的金融資訊。"
SUMMARY = (
    "目前未發現公開資訊觀測站中有資料支持「保證漲停」"
    "或「保證獲利」等說法。若相關內容同時要求加入私人群組，"
    "可能具有行銷或投資詐騙風險。"
)
RISK_LEVEL = "高風險"
SCORE = 23
REASONS = ("內容包含保證獲利或保證漲停等絕對性話術", "未提供可驗證的官方公告或可靠新聞來源", "可能引導使用者加入 LINE 群組或私人投資社團")
SOURCES = ("公開資訊觀測站", "Yahoo 財經新聞", "X 貼文")

#: First characters of JSON documents that are neither objects nor falsy.
_TRUTHY = r"^\s*(\[\s*[^\]\s]|\"[^\"]|-?0*\.?0*[1-9]|true\s*$)"


def requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``question`` (stripped text, '' if there is none) and ``status`` (200, 400, 500).

    Malformed and falsy bodies count as empty objects; other JSON that is not
    an object has status 500.  A null question reads ``None``, true and false
    read ``True`` and ``False``; arrays and objects keep their JSON text.
    """
    fields = F.from_json(F.col(body), "map<string,string>")
    raw = F.get_json_object(body, "$.question")
    # The type of the top-level value, not of one of that name further down.
    top = F.try_variant_get(F.try_parse_json(F.col(body)), "$.question", "variant")
    typed_boolean = F.coalesce(F.schema_of_variant(top) == "BOOLEAN", F.lit(False))
    value = F.when(typed_boolean, F.initcap("raw")).otherwise(F.coalesce("given", F.lit("None")))
    out = bodies.withColumn("fields", fields).withColumn("given", F.try_element_at("fields", F.lit("question"))).withColumn("raw", raw)
    out = out.withColumn("question", F.coalesce(F.when(F.map_contains_key("fields", F.lit("question")), strip(value)), F.lit("")))
    other = F.col("fields").isNull() & F.try_parse_json(body).isNotNull() & F.col(body).rlike(_TRUTHY)
    status = F.when(F.coalesce(other, F.lit(False)), 500).when(F.col("question") == "", 400).otherwise(200)
    return out.withColumn("status", status).drop("fields", "given", "raw")


def payload(question: Column) -> Column:
    """The constant payload around a question."""
    return F.struct(
        F.lit(True).alias("success"), question.alias("question"), F.lit(SUMMARY).alias("summary"), F.lit(RISK_LEVEL).alias("risk_level"),
        F.lit(SCORE).alias("credibility_score"), F.array(*map(F.lit, REASONS)).alias("reasons"), F.array(*map(F.lit, SOURCES)).alias("sources"),
    )


def responses(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``response``: the JSON that answers each body."""
    asked = requests(bodies, body)
    error = F.struct(F.lit(False).alias("success"), F.lit(NO_QUESTION).alias("error"))
    return asked.withColumn("response", F.when(F.col("status") == 200, F.to_json(payload(F.col("question")))).otherwise(F.to_json(error)))


def bind_by_position(slots: Column, items: Column) -> Column:
    """Items put into slots by index: extra items drop, missing ones leave the slot as it was."""
    return F.transform(slots, lambda s, i: F.coalesce(F.get(items, i), s))
