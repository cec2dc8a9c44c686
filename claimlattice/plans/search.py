"""Search by keyword, source, date, field and URL; page parsing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import company_of, keyword_list, normal_url, number_of, source_list, ticker_of, url_host
from ..operators.entities import entity_spans, words_of
from ..operators.search import Request, keyword_search, search
from ..operators.terms import agreeing
from ..session import table
from . import query


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'license') OR contains(text, 'free')")
def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_search(table(spark, sf_dir, "documents"), ("license", "free")).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'the') AND contains(text, 'and')")
def keyword_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_search(table(spark, sf_dir, "documents"), ("the", "and"), match="all").select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE source IN ('src0', 'src3')")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), Request(sources=("src0", "src3"))).select("doc_id", "lang")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Request(start=date(2024, 1, 5), end=date(2024, 1, 10))
    return search(table(spark, sf_dir, "events"), wanted, at="ts").select("event_id", "user_id")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) AND r_regionkey = 1")
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    segment = customer.agg(F.min("c_mktsegment").alias("segment"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = customer.join(segment, F.col("c_mktsegment") == F.col("segment"))
    return found.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("""SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1))
      || substr(regexp_replace(url, '[?#].*$', ''), length(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1) AS normal_url FROM pages""")
def url_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normal_url(F.col("url")).alias("normal_url"))


@query("SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS INTEGER) AS n_text FROM pages")
def page_title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("n_text"))


@query("""SELECT doc_id AS item_id, 'SOCIAL' AS kind, CAST(length(text) AS INTEGER) AS n FROM documents UNION ALL
    SELECT page_id, 'NEWS', CAST(length(html) AS INTEGER) FROM pages UNION ALL SELECT item_id, 'OFFICIAL', CAST(length(text) AS INTEGER) FROM benchmark""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, key, kind, text: table(spark, sf_dir, name).select(F.col(key).alias("item_id"), F.lit(kind).alias("kind"), F.length(text).alias("n"))
    social, news = one("documents", "doc_id", "SOCIAL", "text"), one("pages", "page_id", "NEWS", "html")
    return social.unionByName(news, allowMissingColumns=True).unionByName(one("benchmark", "item_id", "OFFICIAL", "text"), allowMissingColumns=True)


@query("SELECT * FROM (VALUES ('台積電', '2330', 42, 'SOCIAL|NEWS|OFFICIAL', '台積電|AI 概念股|保證獲利')) AS t(company, ticker, score, sources, keywords)")
def parse_displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = spark.createDataFrame([("台積電（2330）", "42 分", "X / Yahoo / MOPS", "台積電、AI 概念股，保證獲利、台積電")], "company string, score string, sources string, keywords string")
    return shown.select(
        company_of(F.col("company")).alias("company"), ticker_of(F.col("company")).alias("ticker"), number_of(F.col("score")).alias("score"),
        F.array_join(source_list(F.col("sources")), "|").alias("sources"), F.array_join(keyword_list(F.col("keywords")), "|").alias("keywords"),
    )


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'free') AND source IN ('src1', 'src2', 'src3') AND lang = 'en'")
def combined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Request(keywords=("free",), sources=("src1", "src2", "src3"))
    return search(table(spark, sf_dir, "documents"), wanted).filter("lang = 'en'").select("doc_id", "source")


@query("SELECT doc_id, concat_ws(',', list_sort(list_distinct(regexp_extract_all(text, '[0-9]{4,}')))) AS numbers FROM documents WHERE regexp_matches(text, '[0-9]{4,}')")
def entity_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]{4,}"))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{4,})"), 1)))
    return docs.select("doc_id", F.array_join(found, ",").alias("numbers"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    g AS (SELECT doc_id, unnest(range(len(w) - 1)) AS place, w FROM d WHERE len(w) > 1),
    b AS (SELECT doc_id, place, w[place + 1] || ' ' || w[place + 2] AS surface FROM g),
    a AS (SELECT item_id AS entity, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:2], ' ') AS form FROM benchmark WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) > 1),
    -- levenshtein counts bytes here, so letters of two bytes are written as capitals.
    c AS (SELECT surface, translate(surface, 'áàâäçéèêëíîïñóôöúùûüßœ', 'ABCDEFGHIJKLMNOPQRSTUV') AS x FROM (SELECT DISTINCT surface FROM b)),
    e AS (SELECT entity, translate(form, 'áàâäçéèêëíîïñóôöúùûüßœ', 'ABCDEFGHIJKLMNOPQRSTUV') AS y FROM a),
    v AS (SELECT surface, min({'distance': levenshtein(x, y), 'entity': entity}) AS m FROM c
      JOIN e ON abs(length(x) - length(y)) <= 1 AND levenshtein(x, y) <= CASE WHEN length(y) >= 5 THEN 1 ELSE 0 END GROUP BY surface),
    h AS (SELECT doc_id, place, surface, m, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM b JOIN v USING (surface)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY place) AS r FROM h)
    SELECT doc_id, CAST(place AS INTEGER) AS place, surface, m.entity AS entity, CAST(m.distance AS INTEGER) AS distance FROM k WHERE r % 2 = 1""")
def alias_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each official text as an alias of it, found in all documents within one edit."""
    w = F.transform(words_of(F.col("text")), lambda x: x["word"])
    official = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), w.alias("w")).filter(F.size("w") > 1)
    aliases = official.select("entity", F.array_join(F.slice("w", 1, 2), " ").alias("alias"))
    found = entity_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), aliases, most_words=2)
    return found.select("doc_id", "place", "surface", "entity", "distance")


def rounded(x: Column, digits: int) -> Column:
    """A positive double rounded as SQL engines do that scale it; ``F.round`` takes its decimal form, which differs at halves."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query(rf"""WITH p AS (SELECT page_id, term, count(*) AS n FROM (SELECT page_id, unnest({_TERMS.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS term FROM pages) GROUP BY ALL),
    b AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
    r AS (SELECT term, ln(1 + (SELECT count(DISTINCT item_id) FROM benchmark) / count(*)) AS idf FROM b GROUP BY term),
    pw AS (SELECT page_id, term, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY page_id)) AS w FROM p JOIN r USING (term)),
    bw AS (SELECT item_id, term, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY item_id)) AS w FROM b JOIN r USING (term)),
    s AS (SELECT page_id, item_id, round(sum(pw.w * bw.w), 9) AS cosine FROM pw JOIN bw USING (term) GROUP BY ALL)
    SELECT page_id, item_id, round(cosine, 5) AS cosine, CAST(row_number() OVER (PARTITION BY page_id ORDER BY cosine DESC, item_id) AS INTEGER) AS rank FROM s WHERE cosine >= 0.1
    QUALIFY rank <= 3""")
def news_filing_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three official texts that each page agrees with most by its rare words."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    found = agreeing(pages, table(spark, sf_dir, "benchmark"), 0.1, 3, "page_id")
    return found.select("page_id", "item_id", rounded(F.col("cosine"), 5).alias("cosine"), "rank")
