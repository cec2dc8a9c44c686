"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of sample texts.  A
text is cut into blocks, each block is encoded with every dictionary, and the
language of the smallest total wins; where the runner-up is nearly as small
the row is marked as rejected.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: ASCII other than letters becomes a space.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower-cased words of letters, one space apart, as bytes."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(PLAIN).split())


def learn(labelled: DataFrame, per_language: int = 200, size: int = 1 << 16) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null ``lang`` of ``labelled(doc_id, text, lang)``.

    A bounded sample: of each language the ``per_language`` rows with the
    least hash of doc_id (then of text), repeated rows once, each with an
    equal share of the ``size`` characters, from a place of its whole text
    that a hash picks.  What reaches the driver is at most ``size`` characters
    a language.  Without rows there is no dictionary.
    """
    rows = labelled.filter("lang is not null and text is not null and text <> ''").select("lang", F.xxhash64("doc_id", F.lit(7)).alias("h"), F.xxhash64("text").alias("t"), "text")
    order = Window.partitionBy("lang").orderBy("h", "t")
    # Hashes alone are ranked; repeated rows are of one rank, of which one row stays.
    least = rows.select("lang", "h", "t").withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= per_language)
    least = least.groupBy("lang", "h", "t").agg(F.min("nth").alias("nth"))
    share = F.ceil(F.lit(size) / F.count(F.lit(1)).over(Window.partitionBy("lang"))).cast("int")
    least = least.withColumn("share", share)
    room = F.greatest(F.length("text") - F.col("share"), F.lit(0)) + 1
    place = (F.pmod(F.xxhash64("h", "t"), room) + 1).cast("int")
    chosen = rows.join(F.broadcast(least), ["lang", "h", "t"]).select("lang", "nth", F.substring("text", place, F.col("share")).alias("text"))
    texts: dict[str, dict] = {}
    for x in chosen.groupBy("lang", "nth").agg(F.min("text").alias("text")).collect():
        texts.setdefault(x["lang"], {})[x["nth"]] = x["text"]
    return {lang: b" ".join(normal(t) for _, t in sorted(ts.items()))[:size] for lang, ts in sorted(texts.items())}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 3, block: int = 4096, margin: float = 0.01, with_text: bool = True) -> DataFrame:
    """``docs`` (needs ``text``; other columns pass through, clashing ones go) plus
    ``lang_pred, score, rejected``.

    ``und`` with score 0 if the text is null or has no letter, or no language
    was learned.  ``score`` weighs the winner against the others, halving an
    other's weight with each byte that it needs more.  ``rejected``: the
    runner-up is within ``margin``, or und.  Ties go to the first language in
    order of code point.  Every block of a text counts, however long; repeated
    rows are each judged alike, and an empty table gives no row.
    """
    added = ("lang_pred", "score", "rejected")
    keep = [c for c in docs.columns if c not in added]
    passed = [c for c in keep if with_text or c != "text"]

    def judge(batches):
        names, at_text = sorted(dictionaries), keep.index("text")
        coders = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False))
        for batch in batches:
            preds, scores, unsure = [], [], []
            for text in batch.column(at_text).to_pylist():
                if not names or text is None or not LETTER.search(text):
                    preds.append(UNKNOWN), scores.append(0.0), unsure.append(True)
                    continue
                data, sizes = normal(text), [0] * len(names)
                for at in range(0, len(data), block):
                    part = data[at : at + block]
                    for i, c in enumerate(coders):
                        sizes[i] += len(c.compress(part))
                best = min(range(len(names)), key=sizes.__getitem__)
                rest = [s for i, s in enumerate(sizes) if i != best]
                preds.append(names[best])
                scores.append(1 / (1 + sum(2.0 ** -min(s - sizes[best], 60) for s in rest)))
                unsure.append(bool(rest) and min(rest) - sizes[best] < margin * min(rest))
            out = [batch.column(keep.index(c)) for c in passed]
            out += [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=[*passed, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*passed).schema)
    return docs.select(*keep).mapInArrow(judge, f"{fields}, lang_pred string, score double, rejected boolean")
