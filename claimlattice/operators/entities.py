"""Entities in texts by a table of aliases, with spelling variants.

An alias is a sequence of words.  Two strings within one edit share a string
that deletes at most one character of each; these (a deletion neighbourhood)
and the words of all aliases are bits in a filter of fixed size.  Texts are read
once, and only places whose sequence passes the filter become rows: of sequences
of several words one word at least must be that of an alias, and then a string
of the neighbourhood.  The vocabulary of what passes is joined with the aliases
on those strings and held to its edit distance.  Matched sequences are then
joined with their places, and of hits that overlap the leftmost, then longest
one stays.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import saver
from .phrases import FILTER_BITS, _filter

#: Shorter aliases must match exactly: one edit would make them something else.
FUZZY_FROM = 5
WORD = re.compile(r"[^\W_]+")


#: Words whose bits a task remembers, and rows that it writes at once.
REMEMBERED, ROWS = 1 << 16, 1 << 14

_WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("finish", T.IntegerType())]))


@F.pandas_udf(_WORDS)
def words_of(texts: pd.Series) -> pd.Series:
    """Lower-cased words with their code points (end exclusive)."""
    return texts.map(lambda t: [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(t)] if t else [])


def neighbourhood(text: Column, fuzzy: Column) -> Column:
    """The text and, if ``fuzzy``, all texts that lack one of its characters."""
    n = F.length(text)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.array_distinct(F.when(fuzzy & (n > 0), F.concat(F.array(text), less)).otherwise(F.array(text)))


def entity_spans(docs: DataFrame, aliases: DataFrame, key: str = "doc_id", text: str = "text", most_words: int = 4) -> DataFrame:
    """``key, place, n_words, start, end, surface, entity, alias, distance`` of all entities in ``docs``.

    ``aliases(entity, alias)``: of at most ``most_words`` words after
    lower-casing and dropping of what is no letter or digit; others, null and
    wordless ones match nothing.  Aliases of ``FUZZY_FROM`` characters or more
    match with one character inserted, dropped or replaced.  Of aliases that
    match one place the nearest, then the least by entity and alias, counts.
    Rows that repeat a key each have their spans.
    """
    words = lambda c: F.transform(words_of(c), lambda w: w["word"])
    known = aliases.filter("entity is not null").select("entity", "alias", words(F.col("alias")).alias("w")).filter(F.size("w").between(1, most_words))
    save = saver(docs.sparkSession, "entities")
    known = save(known.select("entity", "alias", F.array_join("w", " ").alias("form"), F.size("w").alias("n_words"), "w"), "known")
    near = known.withColumn("part", F.explode(neighbourhood(F.col("form"), F.length("form") >= FUZZY_FROM))).drop("w")

    # As ``_places`` writes them.
    parts = near.select(F.concat(F.col("n_words").cast("string"), F.lit(":"), "part").alias("mark"))
    single = known.filter("n_words > 1").select("n_words", F.posexplode("w").alias("i", "word"))
    single = single.select(F.concat(F.col("n_words").cast("string"), F.lit("."), F.col("i").cast("string"), F.lit(":"), "word").alias("mark"))
    bits = _filter(parts.union(single).select(F.crc32("mark").alias("anchor")))
    sizes = sorted(r["n_words"] for r in known.select("n_words").distinct().collect())
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), key, text)
    places = save(rows.mapInArrow(_places(bits.tobytes(), sizes), f"_row long, `{key}` {kind}, place int, surface string, start int, end int, n_words int"), "places")

    # A sequence may be one character shorter than the shortest fuzzy alias.
    vocabulary = places.select("surface", "n_words").distinct()
    parts = vocabulary.withColumn("part", F.explode(neighbourhood(F.col("surface"), F.length("surface") >= FUZZY_FROM - 1)))
    met = parts.join(near, ["part", "n_words"]).withColumn("distance", F.levenshtein("surface", "form"))
    met = met.filter((F.col("distance") == 0) | ((F.col("distance") == 1) & (F.length("form") >= FUZZY_FROM)))
    best = met.groupBy("surface").agg(F.min(F.struct("distance", "entity", "alias")).alias("m")).select("surface", "m.*")

    hits = places.join(best, "surface").select("_row", key, "place", "n_words", "start", "end", "surface", "entity", "alias", "distance")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    kept = hits.repartition("_row").sortWithinPartitions("_row", "place", F.desc("n_words")).mapInArrow(leftmost, types)
    return kept.drop("_row")


class _Remembered(dict):
    """Values of a function, of the last keys that it was asked for."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value = self.of(key)
        return value


def _places(bits: bytes, sizes: list[int]):
    """Batches ``_row, key, text``: the places of sequences of ``sizes`` words that pass the filter."""

    def held(mark: str) -> int:
        at = zlib.crc32(mark.encode()) & (FILTER_BITS - 1)
        return bits[at >> 3] >> (at & 7) & 1

    def near(said: str) -> bool:
        # A sequence may be one character shorter than the shortest fuzzy alias.
        n = said.count(" ") + 1
        return bool(held(f"{n}:{said}")) or (len(said) >= FUZZY_FROM - 1 and any(held(f"{n}:{said[:i]}{said[i + 1 :]}") for i in range(len(said))))

    tests = [(n, i) for n in sizes if n > 1 for i in range(n)]
    flags = {t: 2 << j for j, t in enumerate(tests)}

    def flags_of(word: str) -> int:
        """Bit 0: near an alias of one word; the others: an alias of n words has it at place i."""
        word = word.lower()
        return (1 if 1 in sizes and near(word) else 0) + sum(flags[n, i] for n, i in tests if held(f"{n}.{i}:{word}"))

    def run(batches):
        marked, alike = _Remembered(flags_of), _Remembered(near)
        for batch in batches:
            at, found = [], []
            for row in range(len(batch)):
                text = batch.column(2)[row].as_py() or ""
                words, spans = WORD.findall(text), None
                hot = [(p, m) for p, m in enumerate(map(marked.__getitem__, words)) if m]
                for n in sizes:
                    if n == 1:
                        likely = [p for p, m in hot if m & 1]
                    else:
                        likely = sorted({p - i for i in range(n) for p, m in hot if m & flags[n, i] and 0 <= p - i <= len(words) - n})
                    for p in likely:
                        said = " ".join(w.lower() for w in words[p : p + n])
                        if n == 1 or alike[said]:
                            spans = spans or [m.span() for m in WORD.finditer(text)]
                            at.append(row)
                            found.append((p, said, spans[p][0], spans[p + n - 1][1], n))
                if len(at) >= ROWS or (at and row + 1 == len(batch)):
                    columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()))]
                    taken = [batch.column(i).take(pa.array(at)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*taken, *columns], names=[*batch.schema.names[:2], "place", "surface", "start", "end", "n_words"])
                    at, found = [], []

    return run


def leftmost(batches):
    """Rows ``_row, key, place, n_words, ...`` in order: those that begin behind the last one kept."""
    now, free = None, 0
    for batch in batches:
        keep = []
        for row, place, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if row != now:
                now, free = row, 0
            keep.append(place >= free)
            if keep[-1]:
                free = place + n
        yield batch.filter(pa.array(keep, pa.bool_()))
