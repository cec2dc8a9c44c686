"""Agreement of texts by weighted terms: cosine of tf-idf vectors, pruned by the greatest weight of each term.

An inverted index of all terms would pair nearly everything through common
words.  For each query the terms are ordered by the most that they can add
(its weight times the term's greatest weight in the collection).  The leading
ones are summed first; the tail, which together stays below a fifth of the
threshold, is added only for pairs that it can still lift to the threshold.

Queries are dealt into tasks by their bytes for the counting of words and by
their terms' meetings with the index for the sums, so that no task's table
grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saver

TERM = r"[\p{L}\p{N}]+"

#: Bytes of queries whose words one task counts.
MOST_BYTES = 1 << 22

#: Meetings of a query's term with an entry of the index that one task sums.
MOST_MEETINGS = 1 << 19

#: Entries of an index that goes to every task; a larger one is joined by term.
MOST_ENTRIES = 100_000


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, n`` of lower-cased runs of letters and digits."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))
    return texts.select(F.col(key), F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def unit_weights(counts: DataFrame, key: str, rarity: DataFrame) -> DataFrame:
    """``key, term, idf, w``: counts times rarity, of length 1 for each key.  Terms that have no rarity drop out."""
    weighed = counts.join(rarity, "term").withColumn("w", F.col("n") * F.col("idf"))
    norm = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, key).select(key, "term", "idf", (F.col("w") / F.col("norm")).alias("w"))


def agreeing(queries: DataFrame, collection: DataFrame, least: float, k: int, query_key: str = "query_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``query_key, item_key, cosine, rank``: of each query the ``k`` items with a cosine of at least ``least`` (above 0).

    Rarity is ``ln(1 + items / items with the term)``.  Ties (at 9 digits) go
    to smaller items.  Null, empty and unknown texts agree with nothing; rows
    that repeat a key are one text, rows without a key take no part.
    """
    save = saver(queries.sparkSession, "agreeing")
    counts = save(term_counts(collection, item_key, text), "counts")
    items = collection.select(item_key).distinct().agg(F.count(F.lit(1)).alias("items"))
    # One row joins every term: the number of items.
    rarity = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(items)).select("term", F.log1p(F.col("items") / F.col("df")).alias("idf"))
    index = save(unit_weights(counts, item_key, rarity), "index")
    terms = save(index.groupBy("term").agg(F.max("idf").alias("idf"), F.max("w").alias("most"), F.count(F.lit(1)).alias("df")), "terms")
    small = index.count() <= MOST_ENTRIES

    # Texts travel, not their words: a task that reads them keeps no table.
    texts = queries.select(query_key, text).filter(F.col(query_key).isNotNull())
    n_tasks = 1 + (texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) // MOST_BYTES
    asked = term_counts(texts.repartition(n_tasks, query_key), query_key, text)
    # With a small index the queries stay in the tasks that they were dealt into.
    asked = asked.join(F.broadcast(terms), "term") if small else asked.join(terms, "term").repartition(n_tasks, query_key)
    query = Window.partitionBy(query_key)
    w, bound, tail = F.col("n") * F.col("idf"), F.col("a") * F.col("most"), F.col("tail")
    asked = asked.withColumn("a", w / F.sqrt(F.sum(w * w).over(query)))
    asked = asked.withColumn("tail", F.sum(bound).over(query.orderBy(bound, "term").rowsBetween(Window.unboundedPreceding, 0)))
    # A little slack, as sums are rounded.
    needed = least - 1e-9
    asked = asked.withColumn("below", F.coalesce(F.max(F.when(tail < needed / 5, tail)).over(query), F.lit(0.0)))
    asked = save(asked.select(query_key, "term", "a", "tail", "below", "df"), "asked")
    n_tasks = 1 + (asked.agg(F.sum("df")).first()[0] or 0) // MOST_MEETINGS
    dealt = asked.repartition(n_tasks, query_key)

    index = index.select(item_key, "term", F.col("w").alias("b"))
    index = F.broadcast(index) if small else index
    met = dealt.filter(tail >= needed / 5).select(query_key, "term", "a", "below").join(index, "term")
    met = met if small else met.repartition(n_tasks, query_key, item_key)
    pairs = met.groupBy(query_key, item_key).agg(F.sum(F.col("a") * F.col("b")).alias("led"), F.first("below").alias("below"))
    pairs = pairs.filter(F.col("led") + F.col("below") >= needed).select(query_key, item_key, "led")
    rest = pairs.join(dealt.filter(tail < needed / 5).select(query_key, "term", "a"), query_key, "left").join(index, [item_key, "term"], "left")
    rest = rest if small else rest.repartition(n_tasks, query_key, item_key)
    cosine = F.first("led") + F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0))
    scored = rest.groupBy(query_key, item_key).agg(F.round(cosine, 9).alias("cosine")).filter(F.col("cosine") >= least)
    best = Window.partitionBy(query_key).orderBy(F.desc("cosine"), item_key)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
