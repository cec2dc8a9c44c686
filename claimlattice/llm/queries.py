"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import null_safe
from .common import Workspace, table
from .conversation_repair import repair
from .conversation_sql import OP11_SQL, OP13_SQL
from .digests import joined_sha256
from .exact_sql import OP2_SQL, OP4_SQL, OP6_SQL
from .language import identify, learn
from .mixing import mix
from .packing import pack
from .paragraphs import without_repeats
from .personal_data import KINDS, find_personal
from .prefix_trie import joined_ends, prefix_trie, turns_of
from .quality import classify
from .set_join import similar_sets
from .suffix_dedup import repeated_substrings
from .url_filter import filter_urls, rules_frame
from .vectors import near_vectors, top_k

#: Rows whose crc32 of doc_id has this remainder by 4 are held out.
HELD_OUT = 2


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(spark, docs, with_text=False).select("doc_id", "n_removed", "words_removed", "removed")


def op2_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return classify(spark, docs, table(spark, sf_dir, "labels"), with_text=False).select("doc_id", "text_score", "meta_score", "score", "keep")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_substrings(spark, table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    dictionaries = learn(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), dictionaries, with_text=False)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(spark, docs, with_rows=False).select("doc_id", "size", "source_size", "target", "taken")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(spark, pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


#: Digest of no bytes.
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows that ``op11_conversation_repair`` mends: dropped, emptied, unpunctuated, repeated or renamed by a hash of (conv_id, turn)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mended = repair(spark, damaged(conversations))
    lines = mended.turns.select("conv_id", "at", "place", F.concat_ws(":", "role", "text").alias("line"))
    digests = joined_sha256(lines, ["conv_id"], ["at", "place"], "line", "\n")
    found = null_safe(null_safe(conversations.select("conv_id").distinct(), mended.report, ["conv_id"], "left"), digests, ["conv_id"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(NOTHING)).alias("repaired_sha256"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind in KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


#: Neighbouring conversations of ``op13_prefix_trie`` that begin alike, and the greatest number of turns that they share.
SIBLINGS, MOST_SHARED = 5, 8


def rebuilt(conversations: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(turns, all ids) of the conversations of ``op13_prefix_trie``: some first turns of another one, then their own later ones."""
    turns = ws.save(turns_of(conversations, ws), "turns")
    shared = (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).alias("shared")
    base = (F.col("conv_id") - F.col("conv_id") % SIBLINGS).alias("base")
    everyone = ws.save(conversations.filter("conv_id is not null").select("conv_id").distinct().select("conv_id", base, shared), "everyone")
    heads = turns.filter(F.col("place") <= MOST_SHARED).select(F.col("conv_id").alias("base"), "place", "h1", "h2", "bytes")
    heads = everyone.join(heads, "base").filter("place <= shared").select("conv_id", "place", F.lit(-1).cast("long").alias("_part"), "h1", "h2", "bytes")
    # Later turns move up if the other conversation has fewer turns than are shared.
    had = heads.groupBy("conv_id").agg(F.max("place").alias("had"))
    moved = everyone.join(had, "conv_id", "left").select("conv_id", "shared", (F.coalesce("had", F.lit(0)) - F.col("shared")).alias("move"))
    tails = turns.join(moved, "conv_id").filter("place > shared").select("conv_id", (F.col("place") + F.col("move")).alias("place"), "_part", "h1", "h2", "bytes")
    return heads.unionByName(tails), everyone.select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op13")
    turns, everyone = rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ws)
    trie = prefix_trie(spark, turns, everyone, ws)
    found = trie.nodes.join(joined_ends(trie.ends, ws), ["conv_id", "depth"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), F.coalesce("sha256", F.lit(NOTHING)).alias("ends_sha256")
    )


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fit AS (
  SELECT *,
    ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') AS r1,
    ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') AS r2,
    ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') AS r3,
    ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') AS r4,
    ('.' || host) LIKE '%.com' AND starts_with(path, '/') AS r5
  FROM parts
)
SELECT page_id, host, path,
  CASE WHEN r1 THEN 'www.example.com/en/' WHEN r2 THEN 'example.com/en/' WHEN r3 THEN 'net/es/'
       WHEN r4 THEN 'net/fr/' WHEN r5 THEN 'com/' END AS rule,
  CASE WHEN r1 THEN 'allow' WHEN r2 THEN 'block' WHEN r3 THEN 'block' WHEN r4 THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op2_set_join": OP2_SQL, "op4_top_k": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op10_url_filter": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op13_prefix_trie": OP13_SQL}
