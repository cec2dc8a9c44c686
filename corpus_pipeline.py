"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlattice.llm.common import Workspace, table
from claimlattice.llm.mixing import mix
from claimlattice.llm.packing import pack
from claimlattice.llm.paragraphs import without_repeats
from claimlattice.llm.quality import classify
from claimlattice.llm.set_join import similar_sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Without labels of both classes all stay.  Null and empty texts are judged
    as texts of no words, very long ones whole; repeated rows and ties stay or
    go together; rows of a null doc_id are judged like others; an empty table
    gives an empty one; columns other than those of ``documents`` go.
    """
    return classify(spark, docs.select(*COLUMNS), table(spark, sf_dir, "labels")).filter("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one whose doc_id names it.

    5-word shingles, Jaccard 0.8.  Rows that repeat a doc_id stay or go
    together; null and empty texts link with nothing and stay, as do rows of a
    null doc_id; very long texts count whole; of equal texts the smallest
    doc_id stays; an empty table gives an empty one.
    """
    groups = similar_sets(spark, docs, k=5, percent=80)
    kept = groups.filter("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without paragraphs and passages that an earlier document has.

    No row goes, even if its text becomes empty.  Null and empty texts and
    rows of a null doc_id stay as they are; equal rows are one document and
    lose the same; very long texts are worked through whole; ``n_chars`` is
    that of the new text; an empty table gives an empty one.
    """
    return without_repeats(spark, docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null, empty and wordless texts have no words to take and go.  Null sources
    are one source, the last; rows that repeat a doc_id go together; ties in
    size are broken by a hash of doc_id; an empty table gives an empty one.
    """
    mixed = mix(spark, docs.select(*COLUMNS))
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, length of the bin, offset.

    Null and empty texts have one row of 0 tokens without a bin; very long
    ones are cut into pieces; copies are packed as often as they stand; a null
    doc_id is kept; an empty table gives an empty one.
    """
    return pack(spark, docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packing),
]

#: Co-training and MinHash have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
