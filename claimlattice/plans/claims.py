"""Contract, risk terms, support, scores, verdicts, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import question_or_default
from ..operators import contract, matching, scoring
from ..session import table
from . import query

#: The terms looked for in the driver's tables.
TERMS = {"absolute": ("Licensed under the Apache License",), "funnel": ("@mail", "free")}

#: (id, body, what SQL has for question and status)
BODIES = (
    (1, '{"question":"  x "}', "x", 200),
    (2, '{"other":1}', "", 400),
    (3, '{"question":""}', "", 400),
    (4, '{"question":"　 \\t"}', "", 400),
    (5, "not json", "", 400),
    (6, "null", "", 400),
    (7, "{}", "", 400),
    (8, "[]", "", 400),
    (9, "0", "", 400),
    (10, "false", "", 400),
    (11, '""', "", 400),
    (12, "[1]", "", 500),
    (13, '"abc"', "", 500),
    (14, "5", "", 500),
    (15, "true", "", 500),
    (16, '{"question":null}', "None", 200),
    (17, '{"question":false}', "False", 200),
    (18, '{"question":true}', "True", 200),
    (19, '{"question":0}', "0", 200),
    (20, '{"question":["a"]}', '["a"]', 200),
)
_values = ", ".join(f"({i}, '{q}', {s})" for i, _, q, s in BODIES)


@query(f"SELECT CAST(id AS BIGINT) AS id, question, CAST(status AS INTEGER) AS status FROM (VALUES {_values}) AS t(id, question, status)")
def analyze_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = spark.createDataFrame([(i, b) for i, b, _, _ in BODIES], "id long, body string")
    return contract.requests(bodies).select("id", "question", "status")


@query(
    """SELECT conv_id, turn, regexp_replace(text, '^[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F\\x{85}\\x{A0}\\x{2003}\\x{3000}]+|[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F\\x{85}\\x{A0}\\x{2003}\\x{3000}]+$', '', 'g') AS question
    FROM conversations WHERE role = 'user'"""
)
def question_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", question_or_default(F.col("text")).alias("question"))


@query("SELECT * FROM (VALUES (1, 'a|b|z'), (2, 'a|b'), (3, 'a|b'), (4, 'x|y')) AS t(id, bound)")
def positional_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, ["x", "y", "z"], ["a", "b"]), (2, ["x", "y"], ["a", "b"]), (3, ["x", "y"], ["a", "b", "c"]), (4, ["x", "y"], [])]
    df = spark.createDataFrame(rows, "id int, slots array<string>, items array<string>")
    return df.select("id", F.array_join(contract.bind_by_position(F.col("slots"), F.col("items")), "|").alias("bound"))


def _fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all four flags."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    hits = matching.phrase_hits(docs, table(spark, sf_dir, "benchmark"))
    official = hits.select("doc_id").distinct().withColumn("official", F.lit(True))
    found = matching.copies(docs).join(official, "doc_id", "left")
    terms = scoring.flags(F.col("text"), TERMS)
    return found.select(
        "doc_id", "source", terms["absolute"].alias("absolute"), terms["funnel"].alias("funnel"), F.col("official").isNull().alias("no_support"), (F.col("n_copies") > 1).alias("burst")
    )


FIRED_SQL = """
  SELECT d.doc_id, d.source,
    contains(d.text, 'Licensed under the Apache License') AS absolute,
    contains(d.text, '@mail') OR contains(d.text, 'free') AS funnel,
    NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text)) AS no_support,
    count(*) OVER (PARTITION BY d.text) > 1 AS burst
  FROM documents d"""
SCORE_SQL = "100 - (CASE WHEN absolute THEN 30 ELSE 0 END) - (CASE WHEN no_support THEN 27 ELSE 0 END) - (CASE WHEN funnel THEN 20 ELSE 0 END) - (CASE WHEN burst THEN 15 ELSE 0 END)"


@query(f"""WITH f AS ({FIRED_SQL}), s AS (SELECT doc_id, CAST(greatest(0, {SCORE_SQL}) AS INTEGER) AS score FROM f)
    SELECT doc_id, score, CASE WHEN score >= 80 THEN '低風險' WHEN score >= 50 THEN '中風險' ELSE '高風險' END AS risk_level FROM s""")
def credibility_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = _fired(spark, sf_dir)
    flags = {c: F.col(c) for c in ("absolute", "no_support", "funnel", "burst")}
    scored = fired.select("doc_id", scoring.score(flags).cast("int").alias("score"))
    return scored.withColumn("risk_level", scoring.level(F.col("score")))


@query(f"""WITH f AS ({FIRED_SQL})
    SELECT doc_id, CAST({SCORE_SQL} AS INTEGER) AS score_full,
      CAST(100 - (CASE WHEN absolute THEN 30 ELSE 0 END) - (CASE WHEN no_support THEN 27 ELSE 0 END) AS INTEGER) AS score_truth,
      CAST(100 - (CASE WHEN funnel THEN 20 ELSE 0 END) - (CASE WHEN burst THEN 15 ELSE 0 END) AS INTEGER) AS score_marketing,
      CAST(100 - (CASE WHEN absolute THEN 30 ELSE 0 END) - (CASE WHEN no_support THEN 27 ELSE 0 END) - (CASE WHEN funnel THEN 20 ELSE 0 END) AS INTEGER) AS score_fraud
    FROM f""")
def focus_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {c: F.col(c) for c in ("absolute", "no_support", "funnel", "burst")}
    modes = [scoring.score(flags, focus=m).cast("int").alias(f"score_{m}") for m in ("full", "truth", "marketing", "fraud")]
    return _fired(spark, sf_dir).select("doc_id", *modes)


@query(f"""WITH f AS ({FIRED_SQL})
    SELECT doc_id, concat_ws('|', CASE WHEN absolute THEN '絕對性話術' END, CASE WHEN no_support THEN '缺乏官方或新聞佐證' END,
      CASE WHEN funnel THEN '引導加入群組' END, CASE WHEN burst THEN '相似內容大量出現' END) AS reasons FROM f""")
def reason_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {c: F.col(c) for c in ("absolute", "no_support", "funnel", "burst")}
    return _fired(spark, sf_dir).select("doc_id", F.array_join(scoring.reasons(flags), "|").alias("reasons"))


@query(f"""WITH f AS ({FIRED_SQL}), r AS (
      SELECT doc_id, 1 AS pos, '絕對性話術' AS reason FROM f WHERE absolute UNION ALL
      SELECT doc_id, 2, '缺乏官方或新聞佐證' FROM f WHERE no_support UNION ALL
      SELECT doc_id, 3, '引導加入群組' FROM f WHERE funnel UNION ALL
      SELECT doc_id, 4, '相似內容大量出現' FROM f WHERE burst)
    SELECT doc_id, lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR), 2, '0') AS ordinal, reason FROM r""")
def reason_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {c: F.col(c) for c in ("absolute", "no_support", "funnel", "burst")}
    listed = _fired(spark, sf_dir).select("doc_id", F.posexplode(scoring.reasons(flags)).alias("pos", "reason"))
    return listed.select("doc_id", F.lpad((F.col("pos") + 1).cast("string"), 2, "0").alias("ordinal"), "reason")


@query(f"""WITH f AS ({FIRED_SQL})
    SELECT doc_id, concat('風險分數 ', {SCORE_SQL}, '：', concat_ws('、', CASE WHEN absolute THEN '絕對性話術' END,
      CASE WHEN no_support THEN '缺乏官方或新聞佐證' END, CASE WHEN funnel THEN '引導加入群組' END, CASE WHEN burst THEN '相似內容大量出現' END)) AS summary FROM f""")
def templated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {c: F.col(c) for c in ("absolute", "no_support", "funnel", "burst")}
    line = F.concat(F.lit("風險分數 "), scoring.score(flags).cast("string"), F.lit("："), F.array_join(scoring.reasons(flags), "、"))
    return _fired(spark, sf_dir).select("doc_id", line.alias("summary"))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def official_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return matching.supported(docs.select("doc_id"), matching.phrase_hits(docs, table(spark, sf_dir, "benchmark")))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def official_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return matching.unsupported(docs.select("doc_id"), matching.phrase_hits(docs, table(spark, sf_dir, "benchmark")))


@query("""SELECT b.item_id, count(*) AS n_docs, string_agg(CAST(d.doc_id AS VARCHAR), ',' ORDER BY d.doc_id) AS evidence
    FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id""")
def evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = matching.phrase_hits(docs, table(spark, sf_dir, "benchmark"))
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string"))
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.array_join(ids, ",").alias("evidence"))


@query("""WITH hits AS (
      SELECT 'OFFICIAL' AS source, count(*) AS n_hits, count(*) FILTER (copies > 1) AS n_similar FROM (
        SELECT d.doc_id, count(*) OVER (PARTITION BY d.text) AS copies, d.text FROM documents d) x WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(x.text, b.text))
      UNION ALL SELECT 'NEWS', count(*), 0 FROM pages WHERE contains(html, 'Licensed under the Apache License')
      UNION ALL SELECT 'SOCIAL', count(*), count(*) FILTER (copies > 1) FROM (SELECT text, count(*) OVER (PARTITION BY text) AS copies FROM documents)
        WHERE contains(text, '@mail') OR contains(text, 'free'))
    SELECT source, n_hits, n_similar, CASE WHEN source = 'OFFICIAL' AND n_hits = 0 THEN '未支持' WHEN source = 'SOCIAL' AND n_similar >= 5 THEN '高風險'
      WHEN source = 'NEWS' AND n_hits = 0 THEN '需留意' ELSE '支持' END AS verdict FROM hits""")
def cross_check_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = matching.phrase_hits(texts, table(spark, sf_dir, "benchmark"))
    # Texts are not needed behind their digests and the terms that they hold.
    docs = matching.copies(texts.withColumn("funnel", matching.has_any(F.col("text"), TERMS["funnel"])), keep_text=False)
    alike = (F.col("n_copies") > 1).cast("long").alias("similar")
    official = matching.supported(docs, hits).select(F.lit("OFFICIAL").alias("source"), alike)
    news = table(spark, sf_dir, "pages").filter(F.contains("html", F.lit(TERMS["absolute"][0]))).select(F.lit("NEWS").alias("source"), F.lit(0).cast("long").alias("similar"))
    social = docs.filter("funnel").select(F.lit("SOCIAL").alias("source"), alike)
    counts = official.unionByName(news).unionByName(social).groupBy("source").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("similar").alias("n_similar"))
    sources = spark.createDataFrame([("OFFICIAL",), ("NEWS",), ("SOCIAL",)], "source string")
    zero = F.lit(0).cast("long")
    matrix = sources.join(counts, "source", "left").select("source", F.coalesce("n_hits", zero).alias("n_hits"), F.coalesce("n_similar", zero).alias("n_similar"))
    return matrix.withColumn("verdict", scoring.source_verdict(F.col("source"), F.col("n_hits"), F.col("n_similar")))


@query("""SELECT doc_id, 'absolute' AS category FROM documents WHERE contains(text, 'Licensed under the Apache License')
    UNION ALL SELECT doc_id, 'funnel' FROM documents WHERE contains(text, '@mail') OR contains(text, 'free')""")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fired = scoring.flags(F.col("text"), TERMS)
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fired.items()]))
    return docs.select("doc_id", F.explode(names).alias("category"))


@query("SELECT md5(text) AS digest, count(*) AS n_copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = docs.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_id"))
    return groups.filter("n_copies > 1")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' AND length(text) > 0),
      g AS (SELECT DISTINCT id, substr(text, i, 3) AS s FROM (SELECT id, text, unnest(range(1, greatest(length(text) - 2, 1) + 1)) AS i FROM t)),
      n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
      c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2)
    SELECT a, b, round(c / (na.n + nb.n - c), 6) AS jaccard FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c / (na.n + nb.n - c) >= 0.8""")
def near_duplicate_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that are alike in characters."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user' and length(text) > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    pairs = matching.near_pairs(asked, key="id")
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


NEAR_SQL = r"""t AS (SELECT min(doc_id) AS id, text FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text),
      w AS (SELECT id, [x FOR x IN string_split_regex(lower(text), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM t),
      g AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)),
      n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
      c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
      p AS (SELECT a, b, c / (na.n + nb.n - c) AS jaccard FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c / (na.n + nb.n - c) >= 0.8)"""


@query(f"WITH {NEAR_SQL} SELECT a, b, round(jaccard, 6) AS jaccard FROM p")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct texts, each named by its smallest document."""
    _, pairs = matching.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""WITH RECURSIVE {NEAR_SQL},
      e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
      r(a, b) AS (SELECT id, id FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
      m AS (SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY a)
    SELECT d.doc_id, m.cluster_id, count(*) OVER (PARTITION BY m.cluster_id) AS n_similar FROM documents d JOIN t ON d.text = t.text JOIN m ON m.id = t.id""")
def near_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cluster of alike texts and how many documents are in it."""
    members, pairs = matching.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = members.join(matching.clusters(pairs).withColumnRenamed("node", "class"), "class", "left")
    named = named.select("doc_id", F.coalesce("cluster", "class").alias("cluster_id"))
    sizes = named.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_similar"))
    return named.join(sizes, "cluster_id").select("doc_id", "cluster_id", "n_similar")


@query("""SELECT l.quality, l.toxic, count(*) AS n, count(*) FILTER (contains(d.text, 'free') OR contains(d.text, '@mail')) AS n_funnel
    FROM documents d JOIN labels l USING (doc_id) GROUP BY l.quality, l.toxic""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    funnel = matching.has_any(F.col("text"), TERMS["funnel"])
    return docs.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(funnel).alias("n_funnel"))


@query("""WITH e AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
      s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c
        FROM q JOIN e ON q.vec_id <> e.vec_id)
    SELECT query_id, vec_id, round(c, 4) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) <= 3""")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return matching.cosine_top(rows, rows.filter("vec_id % 20 = 0"), 3).select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"))
