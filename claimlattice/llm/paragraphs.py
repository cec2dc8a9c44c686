"""Substring dedup by paragraph MinHash.

A document's paragraphs are its lines, cut further at every sentence end that
leaves ``min_words`` words on both sides within the line, so no piece of a line
is too short to take part; sentences of over ``LONG`` words are also cut at
words that the word itself picks (by a hash).  Lines of under ``min_words``
words are joined up to that number, and what falls short goes to the paragraph
before.  A text of under ``min_words`` words is compared whole.  Short lines that
open a longer text are no paragraph of their own: they go with the words behind
them where both repeat (below), and stay where only they do, as any other
repeat of under ``min_words`` words within a text.

Equal word sequences are one node; nodes that share a MinHash band are joined
and verified by exact Jaccard of their 5-word shingles, and of each component
all but the earliest occurrence go.  Nodes of one band are not paired with each
other but compared with the most central of them (see ``set_join``).

A passage that starts and ends within other paragraphs shares no paragraph with
its copies.  So texts are cut a second time, into units that begin where a
word pair's hash is least among its ``REACH`` neighbours: such places depend on
the words around them alone and recur in every copy.  Where few words alternate
the least hash recurs within reach, and every ``TIES``-th such place begins a
unit, so a long repetition is a row of equal units (up to ``REACH`` words at its
begin may stay in a copy).  Equal units lead from an
occurrence to the earliest one; neighbouring ones are a run, and from the ends of a
run both texts are followed word by word as far as they agree.  Runs of at
least ``min_words`` words go as well.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blobs import dealt, gathered, having, part_count
from .common import Workspace, components, lean, lean_group
from .hashing import chain, mix, shingles, shingles_of, slabs, text_words, texts_of
from .set_join import GROUP_TABLES, LISTED, dealt_lists, group_links, hub_pairs, lists_of

WORDS = 5
#: At Jaccard 0.8 a band of 2 agrees with p = 0.64, one of 7 bands with p = 0.9992 (9 bands of 3: 0.998).
BANDS, ROWS = 7, 2
MIN_WORDS = 20
LONG = 80
#: Of the words of a long sentence, one in so many ends a piece.
CUT = 16
SENTENCE = re.compile(rb"[.!?][\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BAND = {"tok": "<u8", "node": "<i8", "n": "<u4"}
#: Units: no two begin within so many words; of places that tie, one in so many begins a unit.
REACH, TIES = 6, 8
#: What begins a unit is settled by so many words on either side.  Texts that agree so far beyond
#: the end of a unit have it in common, so nobody who follows a run needs to look further.
SETTLED = 2 * REACH + 2
#: Stands for a paragraph's number where a whole text is compared.
WHOLE = -1
UNIT = {"node": "<u8", "doc": "<i8", "tkey": "<u4", "at": "<u4", "n": "<u4"}
COPY = {"doc": "<i8", "tkey": "<u4", "at": "<u4", "n": "<u4", "from_doc": "<i8", "from_tkey": "<u4", "from_at": "<u4"}


def _places(text: bytes, begin: int, end: int):
    """(end, words) of the pieces of a line at whose ends it may be cut."""
    last = begin
    for stop in [m.end() for m in SENTENCE.finditer(text, begin, end)] + [end]:
        n = len(text[last:stop].split())
        if n > LONG:
            n = 0
            for m in WORD.finditer(text, last, stop):
                n += 1
                if zlib.crc32(m.group().lower()) % CUT == 0:
                    yield m.end(), n
                    n = 0
        if stop > last:
            yield stop, n
        last = stop


def paragraph_spans(text: bytes, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """[begin, end) of each paragraph; together they are the text without the line ends between them."""
    spans, at = [], 0
    #: Begin and words of the short lines joined so far.
    run, held = None, 0

    def close(end):
        if run is not None:
            spans.append((spans.pop()[0] if spans else run, end))

    for line in text.split(b"\n"):
        end, n = at + len(line), len(line.split())
        if n >= min_words:
            close(at - 1)
            begin, run, held, inside = at, None, 0, 0
            for stop, words in _places(text, at, end):
                inside, n = inside + words, n - words
                if inside >= min_words and n >= min_words:
                    spans.append((begin, stop))
                    begin, inside = stop, 0
            spans.append((begin, end))
        else:
            run, held = at if run is None else run, held + n
            if held >= min_words:
                spans.append((run, end))
                run, held = None, 0
        at = end + 1
    close(len(text))
    return spans


def node_hash(words: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A fingerprint of each sequence of shingles."""
    place = mix(np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words ^ place), dtype=np.uint64)))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64))


def distinct(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The size of each sequence's set of shingles."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((shingles, owner))
    s, o = shingles[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(bounds) - 1)


def units(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and number of words of the units of some texts (words ``h``, text i from ``bounds[i]``)."""
    none = np.iinfo(np.uint64).max
    pair = np.full(len(h), none)
    pair[:-1] = mix(chain(h[:-1], h[1:]))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair[bounds[1:][np.diff(bounds) > 0] - 1] = none  # the last word of a text has no pair
    place = np.arange(len(h)) + (text + 1) * REACH
    wide = np.full(len(h) + (len(bounds) + 1) * REACH, none)
    wide[place] = pair
    before, behind = np.full(len(h), none), np.full(len(h), none)
    for j in range(1, REACH + 1):
        before, behind = np.minimum(before, wide[place - j]), np.minimum(behind, wide[place + j])
    least = np.flatnonzero((pair <= before) & (pair <= behind) & (pair != none))
    # Places within reach of each other tie; they are counted from the first of them.
    first = np.ones(len(least), bool)
    first[1:] = np.diff(place[least]) > REACH
    number = np.arange(len(least))
    number -= np.maximum.accumulate(np.where(first, number, 0))
    begin = np.union1d(least[number % TIES == 0], bounds[:-1][np.diff(bounds) > 0])
    return begin, np.diff(np.append(begin, len(h)))


def copies_of(e: dict) -> tuple[np.ndarray, dict]:
    """Of equal units: which entries come first, and all other places with where they come from."""
    order = np.lexsort((e["at"], e["tkey"], e["doc"], e["node"]))
    s = {k: v[order] for k, v in e.items()}
    first = np.ones(len(order), bool)
    first[1:] = s["node"][1:] != s["node"][:-1]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else order
    # The same place again is a repeated row, not a copy.
    other = (s["doc"] != s["doc"][lead]) | (s["tkey"] != s["tkey"][lead]) | (s["at"] != s["at"][lead])
    at, lead = np.flatnonzero(other), lead[other]
    copies = {k: s[k][at] for k in ("doc", "tkey", "at", "n")} | {f"from_{k}": s[k][lead] for k in ("doc", "tkey", "at")}
    return order[first], copies


def _text_key(doc: np.ndarray, tkey: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) + mix(tkey.astype(np.uint64)))


NAMES = ["kind", "doc_id", "tkey", "idx", "at", "words", *LISTED]
TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _rows(kind: int, batch: dict) -> pa.RecordBatch:
    """A batch of all columns; those not in ``batch`` are null."""
    n = len(next(iter(batch.values())))
    batch = {"kind": np.full(n, kind, np.int32)} | batch
    return pa.RecordBatch.from_arrays([pa.array(batch[c], t) if c in batch else pa.nulls(n, t) for c, t in zip(NAMES, TYPES)], names=NAMES)


def _occurrences(min_words: int, parts: int, bands: int, rows: int):
    """Kind 0: paragraphs with their nodes; 1: band keys of nodes new to the task; 2: units; 3: copies of units of this task."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def keys(flat, bounds):
        out = np.zeros((len(bounds) - 1, bands), np.uint64)
        for b in range(bands):
            for r in range(rows):
                least = np.minimum.reduceat((flat ^ seeds[b * rows + r]) * (seeds[b * rows + r] | np.uint64(1)), bounds[:-1])
                out[:, b] = mix(out[:, b] + least)
            out[:, b] = mix(out[:, b] + np.uint64(b + 1))
        return out

    @lean
    def run(batches):
        seen: set[int] = set()
        held, total = [], 0

        def flush():
            e = {k: np.concatenate(c) for k, c in zip(UNIT, zip(*held))}
            held.clear()
            first, copies = copies_of(e)
            out = dealt([v[first] for v in e.values()], mix(e["node"][first]), parts)
            yield _rows(2, {"part": out.column(0), "payload": out.column(1)})
            if len(copies["doc"]):
                out = dealt(list(copies.values()), _text_key(copies["doc"], copies["tkey"]), parts)
                yield _rows(3, {"part": out.column(0), "payload": out.column(1)})

        for batch in batches:
            whole = texts_of(batch.column(2))
            for part in slabs([len(t) for t in whole]):
                texts = whole[part]
                docs, tkeys = (batch.column(c).to_numpy(zero_copy_only=False)[part] for c in (0, 1))
                starts, h, bounds = text_words(texts, True)
                if not len(h):
                    continue
                begin, n = units(h, bounds)
                node = node_hash(h, np.append(begin, len(h)), n)
                some = np.flatnonzero(n >= WORDS)
                text = np.searchsorted(bounds, begin[some], "right") - 1
                held.append((node[some], docs[text], tkeys[text].astype("<u4"), (begin[some] - bounds[text]).astype("<u4"), n[some].astype("<u4")))
                total += len(some)
                if total >= 1 << 17:
                    yield from flush()
                    total = 0

                base = np.cumsum([len(t) + 1 for t in texts]) - [len(t) + 1 for t in texts]
                spans = [(i, j, base[i] + a, base[i] + b) for i, t in enumerate(texts) for j, (a, b) in enumerate(paragraph_spans(t, min_words))]
                text, idx, a, b = np.array(spans, np.int64).reshape(-1, 4).T
                first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
                words, size = last - first, np.diff(bounds)[text]
                idx[size < min_words] = WHOLE
                enough = (words >= min_words) | (words == size) & (size > 0)
                text, idx, first, words = text[enough], idx[enough], first[enough], words[enough]
                if not len(text):
                    continue
                flat, ends = shingles_of(h, first, words, WORDS)
                node = node_hash(flat, ends, words)
                yield _rows(0, {"doc_id": docs[text], "tkey": tkeys[text], "idx": idx.astype(np.int32), "at": (first - bounds[text]).astype(np.int32), "words": words.astype(np.int32), "node": node.view(np.int64)})
                new = []
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                if new:
                    new = np.array(new)
                    take = np.zeros(len(node), bool)
                    take[new] = True
                    fresh, ends = flat[np.repeat(take, np.diff(ends))], np.concatenate(([0], np.cumsum(np.diff(ends)[new])))
                    band, size = keys(fresh, ends).reshape(-1), distinct(fresh, ends)
                    entries = {"tok": band, "node": np.repeat(node[new].view(np.int64), bands), "n": np.repeat(size.astype("<u4"), bands)}
                    for out in dealt_lists(entries, band, parts):
                        yield _rows(1, dict(zip(LISTED, out.columns)))
        if held:
            yield from flush()

    return run


@lean_group
def _band_lists(key, table):
    """Nodes of the bands that two nodes or more have."""
    c, length, _ = lists_of(table, BAND)
    many = length > 1
    return pa.table({"tok": c["tok"][many].view(np.int64), "node": c["node"][many], "n": c["n"][many].astype(np.int64)})


def _unit_copies(parts: int):
    @lean_group
    def run(key, table):
        _, copies = copies_of(gathered(table.column("payload").to_pylist(), UNIT))
        return pa.Table.from_batches([dealt(list(copies.values()), _text_key(copies["doc"], copies["tkey"]), parts)])

    return run


RUN = "doc_id long, tkey long, begin int, end int, side string, at int, from_doc long, from_tkey long, from_at int"


@lean_group
def _runs(key, table):
    """Runs of copied units, once with the place that their begin comes from (l) and once with that of their end (r)."""
    c = gathered(table.column("payload").to_pylist(), COPY)
    order = np.lexsort((c["at"], c["tkey"], c["doc"]))
    c = {k: v[order].astype(np.int64) for k, v in c.items()}
    end = c["at"] + c["n"]
    new = np.ones(len(end), bool)
    # A repeated row's places stand twice.
    new[1:] = (c["doc"][1:] != c["doc"][:-1]) | (c["tkey"][1:] != c["tkey"][:-1]) | (c["at"][1:] > end[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(end)) - 1
    if not len(end):
        a = z = np.zeros(0, np.int64)
    out = [
        {"doc_id": c["doc"][a], "tkey": c["tkey"][a], "begin": c["at"][a], "end": end[z], "side": np.full(len(a), side), "at": at, "from_doc": c["from_doc"][i], "from_tkey": c["from_tkey"][i], "from_at": c["from_at"][i] + more}
        for side, i, at, more in (("l", a, c["at"][a], 0), ("r", z, end[z], c["n"][z]))
    ]
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (f.split() for f in RUN.split(", "))])
    return pa.concat_tables([pa.table([pa.array(o[f.name].tolist(), f.type) for f in schema], schema=schema) for o in out])


def copied_runs(found: DataFrame, parts: int) -> DataFrame:
    """Runs of units that stand earlier as well, in the columns of RUN."""
    blobs = found.filter("kind = 2").select("part", "payload").groupBy("part").applyInArrow(_unit_copies(parts), "part int, payload binary")
    blobs = blobs.union(found.filter("kind = 3").select("part", "payload"))
    return blobs.groupBy("part").applyInArrow(_runs, RUN)


def followed(runs: DataFrame, around: DataFrame) -> DataFrame:
    """``doc_id, tkey, begin, end``: word ranges of the runs, extended on both sides as far as both texts agree."""
    source = around.select(F.col("doc_id").alias("from_doc"), F.col("tkey").alias("from_tkey"), F.col("at").alias("from_at"), "side", F.col("words").alias("from_words"))
    both = runs.join(around, ["doc_id", "tkey", "at", "side"]).join(source, ["from_doc", "from_tkey", "from_at", "side"])
    # Up to the first word that differs (or the shorter end).
    stop = F.array_position(F.zip_with("words", "from_words", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    agreed = F.when(stop > 0, stop - 1).otherwise(F.size("words")).cast("int")
    both = both.withColumn("agreed", agreed).groupBy("doc_id", "tkey", "begin", "end")
    more = [F.max(F.when(F.col("side") == s, F.col("agreed"))) for s in ("l", "r")]
    return both.agg(more[0].alias("l"), more[1].alias("r")).select("doc_id", "tkey", (F.col("begin") - F.col("l")).alias("begin"), (F.col("end") + F.col("r")).alias("end"))


def text_key():
    """A fingerprint of the text that tells texts of one doc_id apart."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))


FETCHED = "node long, text binary, doc_id long, tkey long, at int, side string, words array<int>"


def _fetch(min_words: int):
    """Of each text the wanted paragraphs (``node, text``), and the words before (l, backwards) or from (r) wanted places on."""

    @lean
    def run(batches):
        for batch in batches:
            out = []
            for doc, tkey, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(4))):
                raw = text.encode("utf-8", "surrogatepass")
                spans, h, begin = None, None, None
                for w in wanted:
                    at, side = w["at"], w["side"]
                    if side is None:
                        spans = paragraph_spans(raw, min_words) if spans is None else spans
                        if at < len(spans):
                            a, b = spans[at] if at != WHOLE else (0, len(raw))
                            out.append((w["node"], raw[a:b], None, None, None, None, None))
                        continue
                    if h is None:
                        _, h, bounds = text_words([raw], True)
                        begin = units(h, bounds)[0]
                        h = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    # To the begin of the unit before, or the end of the one from there on.
                    if side == "l":
                        i = np.searchsorted(begin, at) - 1
                        words = h[max(0, begin[i] - SETTLED) if i >= 0 else 0 : at][::-1]
                    else:
                        i = np.searchsorted(begin, at, "right")
                        words = h[at : begin[i] + SETTLED if i < len(begin) else len(h)]
                    out.append((None, None, doc, tkey, at, side, words.tolist()))
            columns = zip(*out) if out else ((),) * 7
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["node", "text", "doc_id", "tkey", "at", "side", "words"])

    return run


def _sets_of(texts):
    for part in slabs([len(t) for t in texts]):
        flat, bounds, n = shingles(texts[part], WORDS, True)
        nodes = node_hash(flat, bounds, n).view(np.int64).tolist()
        for i, node in enumerate(nodes):
            yield node, np.unique(flat[bounds[i] : bounds[i + 1]])


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS, part_bytes: int = 8 << 20, ws: Workspace | None = None) -> DataFrame:
    """``doc_id, tkey, removed, cuts, n_removed, words_removed``: per document that loses some,
    the numbers of its paragraphs to go and the word ranges [begin, end) to cut.

    A text that goes as a whole, having under ``min_words`` words, has a cut and no
    number.  ``tkey`` tells texts of one doc_id apart.  Earliest: smallest doc_id, then
    tkey, then place.  Equal rows are one document, so a repeated row is no
    copy of itself.  Null and empty texts, and rows of a null doc_id, lose
    nothing; an empty table gives no row.  Ties cannot be: places differ.
    Very long texts are worked through whole, one at a time.
    """
    ws = ws or Workspace(spark, "paragraphs")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    keyed = docs.select("doc_id", text_key().alias("tkey"), "text")
    parts = part_count(spark, docs, part_bytes)
    schema = "kind int, doc_id long, tkey long, idx int, at int, words int, tok long, node long, n long, part int, payload binary"
    found = ws.save(keyed.mapInArrow(_occurrences(min_words, parts, bands, rows), schema), "found", by=("kind",))
    places = found.filter("kind = 0").select("node", "at", "words", F.struct("doc_id", "tkey", "idx").alias("place"))
    nodes = ws.save(places.groupBy("node").agg(F.min("place").alias("first"), F.max("place").alias("last")), "nodes")

    keys = found.filter("kind = 1")
    lists = keys.filter("payload is not null").select("part", "payload").groupBy("part").applyInArrow(_band_lists, "tok long, node long, n long")
    lists = ws.save(lists.union(keys.filter("payload is null").select("tok", "node", "n")), "lists")
    ws.drop("found/kind=1")
    pairs = ws.save(hub_pairs(ws, lists, percent, F.lit(bands)), "pairs")
    runs = ws.save(copied_runs(found, parts), "runs")
    ws.drop("found/kind=2", "found/kind=3", "lists", "list-rows", "hubs")

    # Each text that a comparison needs travels once.
    nothing = F.lit(None).cast("string").alias("side"), F.lit(None).cast("long").alias("node")
    wanted = pairs.select("node").union(pairs.select("hub")).distinct().join(nodes.select("node", "first"), "node").select("first.doc_id", "first.tkey", F.col("first.idx").alias("at"), nothing[0], "node")
    for place in (("doc_id", "tkey", "at"), ("from_doc", "from_tkey", "from_at")):
        wanted = wanted.union(runs.select(*place, "side", nothing[1]))
    wanted = ws.save(wanted.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("at", "side", "node")).alias("wanted")), "wanted")
    fetched = having(docs, wanted).withColumn("tkey", text_key()).join(wanted, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "wanted")
    fetched = ws.save(fetched.mapInArrow(_fetch(min_words), FETCHED), "fetched")
    texts = fetched.filter("node is not null").select("node", "text").dropDuplicates(["node"])
    links = ws.save(group_links(ws, pairs, percent, lambda rows: rows.join(texts, "node"), _sets_of), "links")
    comps = ws.save(components(ws, links), "components")

    # Only nodes of a component or of several places can lose a paragraph.
    clusters = nodes.join(comps, "node", "left").filter("component is not null or first <> last")
    clusters = ws.save(clusters.select("node", "first", F.coalesce("component", "node").alias("component")), "clusters")
    keepers = ws.save(clusters.groupBy("component").agg(F.min("first").alias("kept")), "keepers")
    per_node = ws.save(clusters.join(keepers, "component").select("node", "kept"), "per-node")
    # Equal rows of one document name a place twice.
    gone = places.join(per_node, "node").filter("place <> kept").select("place.*", F.col("at").alias("begin"), (F.col("at") + F.col("words")).alias("end")).distinct()
    gone = ws.save(gone, "gone-paragraphs")
    # Repeated rows have the same places; one row of each counts.
    around = ws.save(fetched.filter("node is null").select("doc_id", "tkey", "at", "side", "words").dropDuplicates(["doc_id", "tkey", "at", "side"]), "around")
    passages = followed(runs, around).filter(F.col("end") - F.col("begin") >= min_words)
    cuts = ws.save(gone.select("doc_id", "tkey", "begin", "end").union(passages), "cuts-apart")

    text = Window.partitionBy("doc_id", "tkey").orderBy("begin")
    before = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    cuts = cuts.withColumn("new", F.coalesce(F.col("begin") > before, F.lit(True)).cast("int"))
    cuts = cuts.withColumn("cut", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "tkey", "cut").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    cuts = cuts.groupBy("doc_id", "tkey").agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("cuts"), F.count(F.lit(1)).cast("int").alias("n_removed"), F.sum(F.col("end") - F.col("begin")).cast("long").alias("words_removed")
    )
    removed = gone.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_list(F.when(F.col("idx") != WHOLE, F.col("idx")))).alias("removed"))
    out = ws.save(cuts.join(removed, ["doc_id", "tkey"], "left"), "gone")
    ws.drop("found", "nodes", "pairs", "wanted", "fetched", "links", "components", "clusters", "keepers", "per-node", "gone-paragraphs", "runs", "around", "cuts-apart", *GROUP_TABLES)
    return out


def _drop(names: list[str]):
    at_text, at_cuts = names.index("text"), names.index("cuts")

    @lean
    def run(batches):
        for batch in batches:
            texts, lists = batch.column(at_text).to_pylist(), batch.column(at_cuts).to_pylist()
            for i, cuts in enumerate(lists):
                if cuts:
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    starts, edge, kept = [m.start() for m in WORD.finditer(raw)], 0, []
                    end = len(raw.rstrip(b" \t\n\v\f\r"))
                    for c in cuts:
                        # The white space behind a cut goes with it.
                        kept.append(raw[edge : starts[c["begin"]]])
                        edge = starts[c["end"]] if c["end"] < len(starts) else end
                    kept.append(raw[edge:])
                    texts[i] = b"".join(kept).decode("utf-8", "surrogatepass")
            columns = list(batch.columns)
            columns[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def without_repeats(spark: SparkSession, docs: DataFrame, with_text: bool = True, ws: Workspace | None = None, **how) -> DataFrame:
    """All rows of ``docs`` (needs doc_id, text) with repeated paragraphs and passages cut out of ``text``,
    plus ``removed`` (paragraph numbers), ``cuts`` (word ranges), ``n_removed`` (their number), ``words_removed``.

    Without the text (``with_text=False``) no text is shuffled.  Clashing
    columns are replaced; see ``repeated_paragraphs`` for edge cases.
    """
    ws = ws or Workspace(spark, "paragraphs")
    added = ("removed", "cuts", "n_removed", "words_removed")
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*names)
    gone = repeated_paragraphs(spark, docs, ws=ws, **how).withColumnsRenamed({"doc_id": "gone_id", "tkey": "gone_key"})
    keyed = docs.select(*[c for c in names if with_text or c != "text"], F.col("doc_id").cast("long").alias("own_id"), text_key().alias("own_key"))
    rows = keyed.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_key") == F.col("gone_key")), "left")
    rows = rows.drop("own_id", "own_key", "gone_id", "gone_key")
    rows = rows.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    rows = rows.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<begin:int,end:int>>")))
    rows = rows.withColumn("n_removed", F.coalesce("n_removed", F.lit(0))).withColumn("words_removed", F.coalesce("words_removed", F.lit(0).cast("long")))
    if not with_text:
        return rows
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_drop(rows.columns), schema)
