"""What a client does around the contract: pick the question, branch on the status, bind a result to slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, question_or_default, strip, summary_line
from .contract import bind_by_position

#: Fixed values of the displayed texts.
NO_IMAGE = "尚未選擇圖片"
FAILED = "分析失敗"
FOUND = " 查詢結果"
TAIL = "｜整合三個資料來源產生初步結論。"
PLACEHOLDER = "此區塊目前使用模擬資料，之後可接入實際爬蟲結果與來源連結。"
CHIP = "keyword"
#: Which fields of a request each mode asks with.
MODE_FIELDS = {"ai": ("question",), "text": ("keywords",), "field": ("company", "ticker", "news_url", "post_url"), "voice": ("question",), "image": ()}


def extract_question(requests: DataFrame) -> DataFrame:
    """Adds ``asked``: the first filled field of the request's mode, else the default question."""
    picked = F.lit(None).cast("string")
    for mode, fields in MODE_FIELDS.items():
        if fields:
            picked = F.when(F.col("mode") == mode, first_filled(*[F.col(f) for f in fields])).otherwise(picked)
    return requests.withColumn("asked", question_or_default(picked))


def chip_target(target: Column) -> Column:
    """The field that a clicked chip's text goes to; without one, the keyword field."""
    return F.coalesce(F.nullif(target, F.lit("")), F.lit(CHIP))


def example_text(text: Column) -> Column:
    """What a clicked example puts into the question box."""
    return strip(text)


def image_label(name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(NO_IMAGE))


def outcome(status: Column, error: Column) -> Column:
    """Null if the call went well, else the server's message or the fallback."""
    return F.when(status >= 400, F.coalesce(F.nullif(error, F.lit("")), F.lit(FAILED)))


def failure_note(message: Column) -> Column:
    """What the waiting page shows of a failed call; null if there is no message."""
    return F.concat(F.lit(FAILED + "："), message)


def bind_summary(pages: DataFrame, result: str = "result") -> DataFrame:
    """Binds a JSON result to a page's slots; an invalid or missing result leaves the page as it was.

    ``pages(query, level, score, kinds, reason_slots, source_slots, <result>)``.
    """
    r = F.from_json(F.col(result), "question string, risk_level string, credibility_score int, reasons array<string>, sources array<string>")
    bound = pages.withColumn("r", r)
    named = F.transform("r.sources", lambda s: F.concat(s, F.lit(FOUND)))
    keep = lambda new, old: F.coalesce(new, F.col(old)).alias(old)
    return bound.select(
        keep(summary_line(F.col("r.question")), "query"), keep(F.col("r.risk_level"), "level"), keep(F.col("r.credibility_score"), "score"), keep(F.when(F.col("r.sources").isNotNull(), F.size("r.sources")), "kinds"),
        keep(bind_by_position(F.col("reason_slots"), F.col("r.reasons")), "reason_slots"), keep(bind_by_position(F.col("source_slots"), named), "source_slots"),
    )


def bind_result(pages: DataFrame, result: str = "result") -> DataFrame:
    """Binds a JSON result to all slots of a result page; an invalid or missing result leaves them as they were.

    ``pages(query, title, status_tag, overview, metrics, reason_slots, source_slots, <result>)``:
    metrics is an array of texts (bound if it has three at least, the first
    three only), reason_slots an array of (title, description), source_slots
    one of (label, heading, description).
    """
    r = F.from_json(F.col(result), "question string, summary string, risk_level string, credibility_score int, reasons array<string>, sources array<string>")
    bound = pages.withColumn("r", r)
    keep = lambda new, old: F.coalesce(new, F.col(old)).alias(old)
    shown = F.array(F.concat(F.col("r.credibility_score").cast("string"), F.lit("%")), F.col("r.risk_level"), F.concat(F.size("r.sources").cast("string"), F.lit(" 類")))
    metrics = F.when(F.size("metrics") >= 3, bind_by_position(F.col("metrics"), F.when(F.col("r.sources").isNotNull(), shown)))
    reasons = F.transform("r.reasons", lambda x: F.struct(x.alias("title"), x.alias("description")))
    sources = F.transform("r.sources", lambda s: F.struct(s.alias("label"), F.concat(s, F.lit(FOUND)).alias("heading"), F.lit(PLACEHOLDER).alias("description")))
    others = [F.col(c) for c in pages.columns if c not in (result, "query", "title", "status_tag", "overview", "metrics", "reason_slots", "source_slots")]
    return bound.select(
        *others, keep(F.concat(summary_line(F.col("r.question")), F.lit(TAIL)), "query"), keep(F.col("r.summary"), "title"), keep(F.col("r.risk_level"), "status_tag"), keep(F.col("r.summary"), "overview"),
        keep(metrics, "metrics"), keep(bind_by_position(F.col("reason_slots"), reasons), "reason_slots"), keep(bind_by_position(F.col("source_slots"), sources), "source_slots"),
    )
