"""Search: every field and shared filter of a request, each absent one being no restriction."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_url
from .matching import has_all, has_any


@dataclass(frozen=True)
class Request:
    keywords: tuple[str, ...] = ()
    match: str = "any"
    company: str | None = None
    ticker: str | None = None
    url: str | None = None
    kind: str | None = None
    status: str | None = None
    start: date | None = None
    end: date | None = None
    sources: tuple[str, ...] = ()


def keyword_search(items: DataFrame, keywords, match: str = "any", text: str = "text") -> DataFrame:
    words = [k for k in keywords if k]
    if not words:
        return items
    return items.filter((has_all if match == "all" else has_any)(F.col(text), words))


def in_days(at: Column, start: date | None, end: date | None) -> Column:
    """Both days included; either may be absent."""
    inside = F.lit(True)
    if start:
        inside &= at >= F.lit(start.isoformat()).cast("timestamp_ntz")
    if end:
        inside &= at < F.lit((end + timedelta(days=1)).isoformat()).cast("timestamp_ntz")
    return inside


def search(items: DataFrame, request: Request, text: str = "text", at: str = "published_at", source: str = "source", kind: str = "kind", status: str = "status") -> DataFrame:
    """Applies what the request names; filters on plain columns reach the scan."""
    found = keyword_search(items, request.keywords, request.match, text)
    for column, value in (("company", request.company), ("ticker", request.ticker), (kind, request.kind), (status, request.status)):
        if value:
            found = found.filter(F.col(column) == value)
    if request.url:
        found = found.filter(normal_url(F.col("url")) == normal_url(F.lit(request.url)))
    if request.start or request.end:
        found = found.filter(in_days(F.col(at), request.start, request.end))
    return found.filter(F.col(source).isin(*request.sources)) if request.sources else found


def url_lookup(items: DataFrame, asked: DataFrame, url: str = "url") -> DataFrame:
    """Items whose url is one of those asked for (``asked(url, ...)``), compared in normal form."""
    wanted = asked.withColumn("looked_up", normal_url(F.col(url))).drop(url).filter("looked_up is not null")
    return items.withColumn("looked_up", normal_url(F.col(url))).join(wanted, "looked_up").drop("looked_up")


def drill_down(records: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Records with the rows of the result they name; records without a result go."""
    return records.join(results, key)
