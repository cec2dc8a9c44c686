"""Which texts hold which phrases, for phrase tables of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import saver

#: (bytes of a gram, grams in a window, least bytes of a phrase), the first that a phrase reaches holds for it.
TIERS = ((16, 17, 32), (16, 1, 16), (8, 1, 8), (4, 1, 4), (2, 1, 2), (1, 1, 1))
#: Bits of the filter that drops anchors of texts which no phrase has: 8 MB, whatever the number of phrases.
FILTER_BITS = 1 << 26
#: Bytes of a text that are hashed at once.
SLAB = 1 << 20
#: A row of a phrase table costs the automaton about so many bytes besides its text.
ROW_BYTES = 64


def cost(phrases: DataFrame, phrase: str) -> int:
    """Bytes that the phrases take, with a share for each row."""
    return phrases.agg(F.sum(F.octet_length(F.col(phrase)) + ROW_BYTES)).first()[0] or 0


def _grams(raw: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Of every window of grams the one of least hash; distinct."""
    n = len(raw) - gram + 1
    if n < window:
        return np.zeros(0, np.uint64)
    h = np.full(n, gram * 64 + window, np.uint64)
    for i in range(gram):
        h = (h ^ raw[i : i + n]) * np.uint64(0x100000001B3)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        h = np.minimum(h[:-step], h[step:])
        reach += step
    return np.unique(h)


def anchors(raw: bytes, tiers) -> np.ndarray:
    """The anchors of a text in some tiers.  A text has all anchors of every phrase that stands in it."""
    whole = np.frombuffer(raw, np.uint8)
    found = [np.zeros(0, np.uint64)]
    for gram, window, _ in tiers:
        # Neighbouring slabs share what a window spans.
        shared = gram + window - 2
        found += [_grams(whole[at : at + SLAB + shared].astype(np.uint64), gram, window) for at in range(0, max(1, len(whole) - shared), SLAB)]
    return np.unique(np.concatenate(found))


def _marks(tiers, bits: np.ndarray | None):
    """Batches ``id, text`` become ``id, anchor``: of phrases in their own tier, of texts in all of ``tiers`` and within the filter."""

    def run(batches):
        for batch in batches:
            rows, out = [], [np.zeros(0, np.uint64)]
            for i, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if not raw:
                    continue
                found = anchors(raw, [next(t for t in TIERS if len(raw) >= t[2])] if bits is None else tiers)
                if bits is not None:
                    place = found & np.uint64(FILTER_BITS - 1)
                    found = found[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                rows.append(np.full(len(found), i))
                out.append(found)
            at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(out).view(np.int64))], names=["id", "anchor"])

    return run


def _filter(chosen: DataFrame) -> np.ndarray:
    """The anchors that phrases have, as bits.  At most FILTER_BITS / 64 rows reach the driver."""
    place = F.col("anchor").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = chosen.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(anchor & 63 AS int))")).alias("bits"))
    found = words.toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def hits_by_anchor(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str) -> DataFrame:
    """``key, phrase_key`` of all pairs in which the document contains the phrase; both sides are dealt out as rows.

    A phrase is found by one anchor: the hash of a run of its bytes that is
    the least among its neighbours, so that a text picks the same runs
    wherever the phrase stands.  Of its anchors it takes the one that fewest
    phrases have, so a common opening brings no phrases together.  Texts give
    those of their anchors that pass a filter of fixed size; pairs that share
    an anchor are checked by ``contains``.  Equal texts and equal phrases are
    one until the end.  Null and empty phrases and texts hit nothing; rows
    that repeat are hit as often as they stand.
    """
    save = saver(docs.sparkSession, "phrases")
    terms = save(phrases.filter(F.col(phrase).isNotNull() & (F.col(phrase) != "")).select(F.col(phrase_key).alias("k"), F.md5(phrase).alias("c"), F.col(phrase).alias("p")), "terms")
    classes = save(terms.groupBy("c").agg(F.first("p").alias("p")), "classes")
    marks = classes.select(F.col("c").alias("id"), "p").mapInArrow(_marks(None, None), "id string, anchor long")
    marks = save(marks, "marks")
    rare = marks.join(marks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "anchor")
    chosen = save(rare.groupBy(F.col("id").alias("c")).agg(F.min(F.struct("n", "anchor"))["anchor"].alias("anchor")), "chosen")
    tiers = [t for t, used in zip(TIERS, classes.agg(*[F.coalesce(F.bool_or(_tier(F.octet_length("p"), i)), F.lit(False)).alias(str(i)) for i in range(len(TIERS))]).first()) if used]

    named = docs.select(F.col(key).alias("d_key"), F.md5(text).alias("d"), F.col(text).alias("d_text")).filter("d_text <> ''")
    found = named.select(F.col("d").alias("id"), "d_text").mapInArrow(_marks(tiers, _filter(chosen)), "id string, anchor long").distinct()
    met = found.join(chosen, "anchor").select(F.col("id").alias("d"), "c").join(classes, "c")
    sure = named.join(met, "d").filter(F.contains("d_text", "p")).select("d_key", "c")
    return sure.join(terms.select("k", "c"), "c").select(F.col("d_key").alias(key), F.col("k").alias(phrase_key))


def _tier(size: Column, i: int) -> Column:
    least = size >= TIERS[i][2]
    return least & (size < TIERS[i - 1][2]) if i else least
