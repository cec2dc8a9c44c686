"""Normalisation of claims, and parsers of values that pages write as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip takes off: Unicode white space and 0x1C-0x1F.
EDGES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
#: Names under which one source appears.
SOURCE_NAMES = {
    "公開資訊觀測站": "OFFICIAL",
    "MOPS": "OFFICIAL",
    "官方公告": "OFFICIAL",
    "Yahoo 財經新聞": "NEWS",
    "Yahoo 財經": "NEWS",
    "Yahoo": "NEWS",
    "X 貼文": "SOCIAL",
    "X 社群平台": "SOCIAL",
    "X": "SOCIAL",
}
#: Fixed value: the question taken where none is given.
DEFAULT_QUESTION = "台積電下週保證漲停是真的嗎？"


def strip(text: Column) -> Column:
    """Python's ``str.strip``, which Spark's ``trim`` is not (U+3000, tabs, U+0085, ...)."""
    return F.regexp_replace(text, EDGES, "")


def question_or_default(text: Column, default: str = DEFAULT_QUESTION) -> Column:
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(default))


def first_filled(*fields: Column) -> Column:
    """The first field that is not blank, stripped; null if none is."""
    return F.get(F.array_compact(F.array(*[F.nullif(strip(f), F.lit("")) for f in fields])), F.lit(0))


def canonical_source(name: Column) -> Column:
    pairs = [F.lit(x) for kv in SOURCE_NAMES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), strip(name))


def company_of(text: Column) -> Column:
    """``台積電（2330）`` -> ``台積電``."""
    return strip(F.regexp_replace(text, "（[^）]*）\\s*$", ""))


def ticker_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "（([0-9A-Za-z.]+)）", 1), F.lit(""))


def number_of(text: Column) -> Column:
    """The first run of digits of ``42 分``, ``3 類``, ``28 筆`` or ``23%`` as an int; else null."""
    return F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).try_cast("int")


def source_list(text: Column) -> Column:
    """``X / Yahoo / MOPS`` -> array of canonical sources, unknown names as they are."""
    return F.transform(F.split(text, r"\s*/\s*"), lambda s: F.coalesce(canonical_source(s), s))


def keyword_list(text: Column) -> Column:
    """Keywords set apart by ``、`` or a comma (not by spaces: a keyword may hold one)."""
    parts = F.transform(F.split(text, "[、,，]+"), strip)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def summary_line(question: Column) -> Column:
    return F.concat(F.lit("查詢內容：「"), question, F.lit("」"))


def normal_url(url: Column) -> Column:
    """Scheme and host lower-cased, query and fragment cut off; null if there is no scheme."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    head = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
