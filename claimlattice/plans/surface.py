"""What pages offer around the analysis: chips, lookups, drill-down, stored values, entities, categories, full bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import client, contract, matching, scoring
from ..operators.search import Request, drill_down, search, url_lookup
from ..operators.sketches import daily_sketches, merged
from ..scratch import saver, scratch_folder
from ..session import table
from . import query

#: Aliases and categories that the driver's tables can hold.
ENTITIES = {"Apache": ("Apache License", "apache.org"), "MIT": ("MIT License",), "GNU": ("GNU",), "mail": ("@mail",)}
CATEGORIES = {"insider": ("scum", "loser"), "urgency": ("free",), "guru": ("idiot",)}


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_folder(spark, name)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'question' ELSE 'keyword' END AS target, source AS value FROM documents")
def keyword_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    chips = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "question").otherwise("").alias("target"), "source")
    return chips.select("doc_id", client.chip_target(F.col("target")).alias("target"), F.col("source").alias("value"))


@query(r"SELECT conv_id, turn, regexp_replace(text, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g') AS box FROM conversations WHERE role = 'assistant'")
def example_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return shown.select("conv_id", "turn", client.example_text(F.col("text")).alias("box"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '尚未選擇圖片' ELSE concat(page_id, '.png') END AS label FROM pages")
def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 != 0, F.concat(F.col("page_id").cast("string"), F.lit(".png"))).otherwise("").alias("name"))
    return chosen.select("page_id", client.image_label(F.col("name")).alias("label"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, (ts, event_type)) AS value FROM events GROUP BY user_id")
def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event puts its type under its user; the latest stays."""
    path = _folder(spark, "stored")
    entries = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("ts").cast("timestamp_ntz").alias("put_at"))
    for half in (0, 1):
        sources.put(entries.filter(F.pmod(F.hash("put_at"), F.lit(2)) == half), path)
    return sources.get(spark, path)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def announcement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Request(kind="1-URGENT", status="F")
    return search(table(spark, sf_dir, "orders"), wanted, kind="o_orderpriority", status="o_orderstatus").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def company_ticker_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "customer").withColumnsRenamed({"c_mktsegment": "company"}).withColumn("ticker", F.col("c_nationkey").cast("string"))
    return search(items, Request(company="BUILDING", ticker="7")).select("c_custkey", "c_name")


@query("""SELECT p.page_id, a.page_id AS asked_id FROM pages a JOIN pages p
    ON lower(regexp_extract(regexp_replace(a.url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || regexp_extract(regexp_replace(a.url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$', 1)
     = lower(regexp_extract(regexp_replace(p.url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || regexp_extract(regexp_replace(p.url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$', 1)
    WHERE regexp_matches(a.url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]')""")
def url_lookup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page looked up by its url with another query and fragment and in other case."""
    pages = table(spark, sf_dir, "pages")
    head = F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    shouted = F.concat(F.upper(head), F.regexp_replace(F.substring("url", F.length(head) + 1, F.length("url")), "[?#].*$", ""), F.lit("?again=1#x"))
    asked = pages.filter(head != "").select(F.col("page_id").alias("asked_id"), shouted.alias("url"))
    return url_lookup(pages.select("page_id", "url"), asked).select("page_id", "asked_id")


@query("""SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders)""")
def record_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member's records, each with the rows of its result."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = orders.agg(F.min("o_custkey")).first()[0]
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return drill_down(orders.filter(F.col("o_custkey") == F.lit(first)), results, "o_orderkey").select("o_orderkey", "l_linenumber", "l_quantity")


_LINE = f"'查詢內容：「' || q || '」{client.TAIL}'"
_SOURCES = "|".join(f"{s}={s}{client.FOUND}={client.PLACEHOLDER}" for s in contract.SOURCES) + "|d=d=d"


@query(f"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '^[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{2003}}\\x{{3000}}]+|[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{2003}}\\x{{3000}}]+$', '', 'g') AS q FROM conversations)
    SELECT conv_id, turn, CASE WHEN q <> '' THEN {_LINE} ELSE 'old' END AS query, CASE WHEN q <> '' THEN '{contract.SUMMARY}' ELSE 'old' END AS title, CASE WHEN q <> '' THEN '{contract.RISK_LEVEL}' ELSE 'old' END AS status_tag,
      CASE WHEN q <> '' THEN '{contract.SUMMARY}' ELSE 'old' END AS overview, CASE WHEN q <> '' THEN '{contract.SCORE}%|{contract.RISK_LEVEL}|3 類|m4' ELSE 'm1|m2|m3|m4' END AS metrics,
      CASE WHEN q <> '' THEN '{"|".join(f"{r}={r}" for r in contract.REASONS)}' ELSE 'x=x|y=y|z=z' END AS reasons, CASE WHEN q <> '' THEN '{_SOURCES}' ELSE 'a=a=a|b=b=b|c=c=c|d=d=d' END AS sources FROM a""")
def result_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn asked, and its answer bound to all slots of a result page; failed calls leave the page."""
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("question"))).alias("body"))
    answered = contract.responses(asked).select("conv_id", "turn", F.when(F.col("status") == 200, F.col("response")).alias("result"))
    old = lambda *names: F.array(*[F.struct(*[F.lit(n).alias(f) for f in fields]) for n in names])
    fields = ("title", "description")
    reasons = old("x", "y", "z")
    fields = ("label", "heading", "description")
    places = old("a", "b", "c", "d")
    pages = answered.select("*", *[F.lit("old").alias(c) for c in ("query", "title", "status_tag", "overview")], F.array(*[F.lit(f"m{i}") for i in (1, 2, 3, 4)]).alias("metrics"), reasons.alias("reason_slots"), places.alias("source_slots"))
    shown = client.bind_result(pages)
    line = lambda slots, *names: F.array_join(F.transform(slots, lambda s: F.concat_ws("=", *[s[n] for n in names])), "|")
    return shown.select("conv_id", "turn", "query", "title", "status_tag", "overview", F.array_join("metrics", "|").alias("metrics"), line("reason_slots", "title", "description").alias("reasons"), line("source_slots", *fields).alias("sources"))


@query("SELECT doc_id, concat_ws('|', CASE WHEN contains(text, 'Apache License') OR contains(text, 'apache.org') THEN 'Apache' END, CASE WHEN contains(text, 'MIT License') THEN 'MIT' END, CASE WHEN contains(text, 'GNU') THEN 'GNU' END, CASE WHEN contains(text, '@mail') THEN 'mail' END) AS entities FROM documents")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named by their aliases, in the order of the dictionary."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(matching.mentions(F.coalesce("text", F.lit("")), ENTITIES), "|").alias("entities"))


@query("""SELECT doc_id, category FROM (SELECT doc_id, text, unnest(['insider', 'urgency', 'guru']) AS category FROM documents)
    WHERE (category = 'insider' AND (contains(text, 'scum') OR contains(text, 'loser'))) OR (category = 'urgency' AND contains(text, 'free')) OR (category = 'guru' AND contains(text, 'idiot'))""")
def phrase_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider, urgency and guru phrases by category; terms are a parameter."""
    fired = scoring.flags(F.col("text"), CATEGORIES)
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fired.items()]))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(names).alias("category"))


@query("""WITH b AS (SELECT item_id, text FROM benchmark), t AS (SELECT page_id, strip AS title FROM (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS strip FROM pages) WHERE length(strip) > 0)
    SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM b WHERE contains(d.text, b.text)) AND NOT EXISTS (SELECT 1 FROM t WHERE contains(d.text, t.title))""")
def unsupported_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that neither an official text nor a news title supports."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    titles = table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("text"))
    phrases = table(spark, sf_dir, "benchmark").select("text").union(titles.select("text"))
    return matching.unsupported(docs.select("doc_id"), matching.holding(docs, phrases))


@query("SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, sum(CAST(value AS INTEGER)) AS score FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' AND event_type = 'view' GROUP BY 1")
def history_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended to the history, read back for three days; only their partitions are read."""
    path = _folder(spark, "history")
    events = table(spark, sf_dir, "events").filter("event_type = 'view'")
    records = events.select(F.col("ts").cast("timestamp_ntz").alias("analyzed_at"), F.col("props").alias("query"), F.array(F.lit("SOCIAL")).alias("sources"), F.bround("value").cast("int").alias("score"), F.lit(scoring.LOW).alias("risk_level"))
    sources.append_history(records, path)
    found = sources.read_history(spark, path).filter("analysis_date between '2024-01-10' and '2024-01-12'")
    return found.groupBy(F.col("analysis_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query("SELECT count(*) AS n, count(*) FILTER (regexp_matches(coalesce(text, ''), '[^ \\t\\n\\r\\x0B\\f\\x1C-\\x1F\\x{85}\\x{A0}\\x{2003}\\x{3000}]')) AS n_good FROM conversations")
def requests_to_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies written and scanned as lines of JSON, answers written and read back."""
    path = _folder(spark, "requests")
    table(spark, sf_dir, "conversations").select(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("question"))).alias("value")).write.text(f"{path}/in")
    sources.write_responses(contract.responses(sources.read_requests(spark, f"{path}/in")), f"{path}/out")
    back = spark.read.schema("success boolean, question string").json(f"{path}/out")
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_good"))


@query("SELECT user_id, event_type FROM events WHERE event_type IN ('view', 'click') EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_type = 'click'")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    return events.filter("event_type in ('view', 'click')").exceptAll(events.filter("event_type = 'click'"))


@query("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'click'")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.filter("event_type = 'view'").select("user_id").intersectAll(events.filter("event_type = 'click'").select("user_id"))


@query("SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def join_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One join by each strategy that a hint can ask for; nation and region hold 25 and 5 rows at any scale."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    placed = customer.join(nation.hint("broadcast"), F.col("c_nationkey") == F.col("n_nationkey")).join(region.hint("shuffle_hash"), F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.join(orders.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, levenshtein(c_mktsegment, 'BUILDINGS') AS distance, c_name ILIKE 'customer%1' AS alike,
    CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 5 ELSE CAST(floor(c_acctbal / 2500) AS BIGINT) + 1 END AS bucket FROM customer""")
def text_and_bucket_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.select("c_custkey", F.levenshtein("c_mktsegment", F.lit("BUILDINGS")).cast("long").alias("distance"), F.col("c_name").ilike("customer%1").alias("alike"), F.width_bucket("c_acctbal", F.lit(0.0), F.lit(10000.0), F.lit(4)).alias("bucket"))


@query("""SELECT user_id, concat_ws(',', list_sort(list(event_type || '=' || n))) AS counts, max(n) AS most FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id")
    by_type = counts.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    line = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return by_type.select("user_id", line.alias("counts"), F.array_max(F.map_values("m")).alias("most"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


@query("SELECT c_custkey, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS missing FROM customer")
def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.parse_json(F.to_json(F.struct("c_name", "c_acctbal")))
    parsed = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))
    got = lambda path, kind: F.try_variant_get("v", path, kind)
    return parsed.select("c_custkey", got("$.c_name", "string").alias("name"), got("$.c_acctbal", "double").alias("balance"), got("$.none", "string").alias("missing"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, true AS approx_close, true AS sketch_close FROM events GROUP BY event_type")
def approx_distinct_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts and sketches stay within a tenth of the exact number."""
    exact = F.count_distinct("user_id")
    close = lambda estimate: F.abs(estimate - exact) <= 0.1 * exact
    by = table(spark, sf_dir, "events").groupBy("event_type")
    return by.agg(exact.alias("n_users"), close(F.approx_count_distinct("user_id", 0.02)).alias("approx_close"), close(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", F.lit(14)))).alias("sketch_close"))


@query("SELECT l_returnflag, unnest(CAST([0.1, 0.5, 0.9] AS DOUBLE[])) AS share, true AS close FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def approx_percentile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows of a group the named share, give or take a hundredth, lies at or below the approximate percentile."""
    shares = (0.1, 0.5, 0.9)
    prices = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    found = prices.groupBy("l_returnflag").agg(F.percentile_approx("x", list(shares), 10000).alias("at"))
    below = [F.avg((F.col("x") <= F.get("at", F.lit(i))).cast("double")) for i in range(len(shares))]
    ranks = prices.join(found, "l_returnflag").groupBy("l_returnflag").agg(*[b.alias(f"b{i}") for i, b in enumerate(below)])
    rows = F.array(*[F.struct(F.lit(s).alias("share"), (F.abs(F.col(f"b{i}") - s) <= 0.01).alias("close")) for i, s in enumerate(shares)])
    return ranks.select("l_returnflag", F.explode(rows).alias("r")).select("l_returnflag", "r.share", "r.close")


@query("""WITH e AS (SELECT * FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
    SELECT a.event_type AS first, b.event_type AS second, true AS both_close, true AS only_first_close, true AS median_close
    FROM (SELECT DISTINCT event_type FROM e) a JOIN (SELECT DISTINCT event_type FROM e) b ON a.event_type < b.event_type""")
def sketches_of_a_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by day, merged over sixteen days: members whom two kinds of events share, and whom only the first has,
    within a twentieth of all of the first; the median within a fiftieth of ranks.  Exact counts beside them."""
    events = table(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    daily = saver(spark, "sketches")(daily_sketches(events, day, "event_type", "user_id", "value"), "daily")
    found = merged(daily, "2024-01-05", "2024-01-20", "event_type")
    a, b = found.select(F.col("event_type").alias("first"), F.col("keys").alias("x"), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)).alias("median")), found.select(F.col("event_type").alias("second"), F.col("keys").alias("y"))
    pairs = a.join(b, F.col("first") < F.col("second"))
    estimate = F.theta_sketch_estimate
    pairs = pairs.select("first", "second", "median", estimate(F.theta_intersection("x", "y")).alias("both"), estimate(F.theta_difference("x", "y")).alias("only_first"))

    inside = events.filter(day.between("2024-01-05", "2024-01-20"))
    have = inside.select("event_type", "user_id").distinct()
    mine, theirs = have.select(F.col("event_type").alias("first"), "user_id"), have.select(F.col("event_type").alias("second"), "user_id")
    both = mine.join(theirs, "user_id").filter("first < second").groupBy("first", "second").agg(F.count(F.lit(1)).alias("n_both"))
    sizes = mine.groupBy("first").agg(F.count_distinct("user_id").alias("n_first"))
    below = inside.select(F.col("event_type").alias("first"), "value").join(pairs.select("first", "median").distinct(), "first").groupBy("first").agg(F.avg((F.col("value") <= F.col("median")).cast("double")).alias("below"))
    exact = pairs.join(both, ["first", "second"], "left").na.fill(0, ["n_both"]).join(sizes, "first").join(below, "first")
    close = lambda x, y: F.abs(x - y) <= 0.05 * F.col("n_first")
    return exact.select(
        "first", "second", close(F.col("both"), F.col("n_both")).alias("both_close"), close(F.col("only_first"), F.col("n_first") - F.col("n_both")).alias("only_first_close"),
        (F.abs(F.col("below") - 0.5) <= 0.02).alias("median_close"),
    )


@query("SELECT page_id, url_decode(replace(url, '/', '%2F')) AS url FROM pages")
def url_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.try_url_decode(F.replace("url", F.lit("/"), F.lit("%2F"))).alias("url"))
