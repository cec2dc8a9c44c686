"""Exact substring dedup with a logarithmic family of (sparse) suffix arrays.

Every window of ``length`` bytes has an anchor: the least of its byte
``GRAM``-grams by fingerprint, the leftmost of equals.  Equal windows have
their anchor at the same place, so only suffixes that start at anchors need
an entry in a suffix array (about one byte in 36).  An entry stands for the
run of windows that share the anchor; it holds a fingerprint of the suffix's
first bytes (by which arrays are sorted: any total order merges as well as
the lexicographic one) and one of all bytes that the run's windows cover.

Documents arrive in batches in order of doc_id.  Each batch gets an array of
its own, is merge-scanned against the existing levels, and then joins them as
a level of its own; levels of like size merge, so there are O(log n) levels.
Key ranges of the arrays are independent and lie in different tasks.  With an
``index`` folder the levels stay on shared storage, and later runs scan their
documents against them and add a level (see ``Index``).

A run found whole at an earlier place is a duplicate in all its windows.  If
only the anchor's gram was found there, the windows are settled one by one:
of equal windows all but the first are duplicates.  No occurrence is ever
paired with another, so very common passages cost no more than rare ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blobs import dealt, gathered, having, part_count
from .common import Workspace, lean, lean_group
from .hashing import WIDE, mix, octets, powers, prefix_sums, slabs, texts_of

GRAM = 30
#: Positions in a slab; window minima carry theirs in this many low bits.
BITS = 21
ENTRY = {"gram": "<u8", "run": "<u8", "doc": "<i8", "at": "<u4", "more": "<u4"}
SPAN = {"doc": "<i8", "gram": "<u8", "at": "<u4", "end": "<u4"}
WINDOW = {"h": "<u8", "doc": "<i8", "at": "<u4"}


def pieces(texts: list[bytes], length: int):
    """(text number, offset, bytes) such that every window lies in just one piece."""
    step = (1 << BITS - 1) - length
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, step):
            yield i, at, text[at : at + step + length - 1]


def runs(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (piece, first window, last window, gram, content) arrays."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    sums, down = prefix_sums(mix(octets(data))), powers(len(data) + 1)[1]
    n = len(data) - GRAM + 1
    # A string's sum is over all its octets.
    gram = mix((sums[GRAM - WIDE + 1 :][:n] - sums[:n]) * down[:n])
    low = np.uint64((1 << BITS) - 1)
    least = (gram & ~low) | np.arange(n, dtype=np.uint64)
    span, reach = length - GRAM + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = span - reach
    least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & low).astype(np.int64)
    piece = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
    windows = np.flatnonzero(np.arange(len(anchor)) + length <= ends[piece])
    anchor, piece = anchor[windows], piece[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    begin = np.flatnonzero(new)
    first, last = windows[begin], windows[np.append(begin[1:], len(windows)) - 1]
    a, p = anchor[begin], piece[begin]
    content = (sums[last + length - WIDE + 1] - sums[first]) * down[first]
    place = ((a - first) << 16 | (last - first)).astype(np.uint64)
    base = (ends - sizes)[p]
    return p, first - base, last - base, mix(gram[a]), mix(content ^ mix(place + np.uint64(1)))


def _entries(length: int, parts: int):
    """Entries dealt by gram; runs that a task has seen before are duplicates at once."""

    @lean
    def run(batches):
        held, total = [], 0

        def flush():
            gram, content, doc, at, more = (np.concatenate(c) for c in zip(*held))
            held.clear()
            both = gram ^ mix(content)
            order = np.lexsort((at, doc, both))
            b, d, a = both[order], doc[order], at[order]
            first = np.ones(len(b), bool)
            first[1:] = b[1:] != b[:-1]
            # The same (doc, at) again is the same place, not a copy of it.
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            copy = (d != d[lead]) | (a != a[lead])
            pick = order[first]
            fresh = dealt([gram[pick], content[pick], doc[pick], at[pick], more[pick]], mix(gram[pick]), parts)
            yield _tagged(fresh, 0)
            pick = order[copy]
            if len(pick):
                yield _tagged(dealt([doc[pick], np.zeros(len(pick), "<u8"), at[pick], at[pick] + more[pick] + np.uint32(length)], _doc_key(doc[pick]), parts), 1)

        for batch in batches:
            ids, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            found = list(pieces(texts_of(batch.column(1)), length))
            for part in slabs([len(f[2]) for f in found], 1 << BITS - 1):
                these = found[part]
                p, first, last, gram, content = runs([f[2] for f in these], length)
                if len(p):
                    at = first + np.array([base[f[0]] + f[1] for f in these])[p]
                    held.append((gram, content, ids[np.array([f[0] for f in these])][p].astype("<i8"), at.astype("<u4"), (last - first).astype("<u4")))
                    total += len(p)
                if total >= 1 << 19:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return run


def _doc_key(doc: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) + np.uint64(1))


def _tagged(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), kind, np.int32)), *batch.columns], names=["kind", "part", "payload"])


def _kinds(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Records of a part (kind 0), and the spans that pass through it to their documents (kind 1)."""
    first = pc.equal(table.column("kind"), 0)
    return table.filter(first), table.filter(pc.invert(first)).select(["part", "payload"])


def _pick(entries: dict, index: np.ndarray) -> dict:
    return {k: v[index] for k, v in entries.items()}


def merge(a: dict, b: dict) -> dict:
    """Two sorted levels as one: entries of b take their places among those of a."""
    at = np.searchsorted(a["both"], b["both"]) + np.arange(len(b["both"]))
    out = {}
    for k in a:
        column = np.empty(len(a[k]) + len(b[k]), a[k].dtype)
        rest = np.ones(len(column), bool)
        rest[at] = False
        column[at], column[rest] = b[k], a[k]
        out[k] = column
    return out


def _with_keys(e: dict) -> dict:
    return e | {"both": e["gram"] ^ mix(e["run"])}


@lean_group
def _merged_level(key, table):
    """The sorted entries of one part of two levels, merged."""
    a, b = (_with_keys(gathered([x], ENTRY)) for x in (table.column("payload").to_pylist() + [b""])[:2])
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "payload": pa.array([_bytes(merge(a, b))], pa.binary())})


def _bytes(e: dict) -> bytes:
    return b"".join(e[k].astype(t).tobytes() for k, t in ENTRY.items())


class Index:
    """Levels on shared storage: folders ``parts-P/level-I-N`` with a sorted array for each of P key ranges.

    I numbers the levels, N counts their entries.  A run adds a level; while
    the last two are of like size, they merge into a new one.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int):
        self.spark, self.files = spark, spark._jvm.org.apache.hadoop.fs
        kept = self._names(path)
        self.parts = int(kept[0].split("-")[1]) if kept else parts
        self.path = f"{path.rstrip('/')}/parts-{self.parts}"

    def _at(self, path: str):
        p = self.files.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def names(self) -> list[str]:
        """The levels, largest first; a level that is only half written does not count."""
        found = [n for n in self._names(self.path) if n.startswith("level-") and self._at(f"{self.path}/{n}/_SUCCESS")[1].exists(self._at(f"{self.path}/{n}/_SUCCESS")[0])]
        return sorted(found, key=lambda n: -int(n.split("-")[2]))

    def blobs(self) -> list[DataFrame]:
        return [self.spark.read.schema("part int, payload binary").parquet(f"{self.path}/{n}") for n in self.names()]

    def add(self, level: DataFrame) -> None:
        width = sum(np.dtype(t).itemsize for t in ENTRY.values())
        number = 1 + max([int(n.split("-")[1]) for n in self.names()], default=0)
        n = (level.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) // width
        if n:
            level.write.parquet(f"{self.path}/level-{number}-{n}")
        while len(names := self.names()) > 1 and 2 * (small := int(names[-1].split("-")[2])) > (large := int(names[-2].split("-")[2])):
            number += 1
            (a, b) = self.blobs()[-2:]
            a.union(b).groupBy("part").applyInArrow(_merged_level, "part int, payload binary").write.parquet(f"{self.path}/level-{number}-{small + large}")
            for name in names[-2:]:
                p, fs = self._at(f"{self.path}/{name}")
                fs.delete(p, True)


class Family:
    """Levels of sorted entries (one for each distinct run), the largest first."""

    def __init__(self):
        self.levels: list[dict] = []

    def known(self, both: np.ndarray) -> np.ndarray:
        """Merge-scan: which of the sorted keys a level has."""
        found = np.zeros(len(both), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["both"], both), len(level["both"]) - 1)
            found |= level["both"][at] == both
        return found

    def add(self, level: dict) -> None:
        """Appends a level; while the last two are of like size, they merge."""
        if len(level["both"]):
            self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-1]["both"]) * 2 > len(self.levels[-2]["both"]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merge(a, b))


def _scan(length: int, cuts: list[int], parts: int, keep: bool):
    """Feeds the batches of one key range to a family; spans of duplicates (gram 0) and open runs, dealt by document (kind 1).

    Kinds from 2 on are levels that stood before; with ``keep`` the entries
    new to them come out as kind 3, sorted.
    """

    @lean_group
    def run(key, table):
        part = table.column("part")[0].as_py()
        kinds = table.column("kind").to_numpy()
        stood = [_with_keys(gathered(table.filter(pa.array(kinds == k)).column("payload").to_pylist(), ENTRY)) for k in np.unique(kinds[kinds > 1])]
        table, spans = _kinds(table.filter(pa.array(kinds < 2)))
        e = _with_keys(gathered(table.column("payload").to_pylist(), ENTRY))
        e = _pick(e, np.lexsort((e["at"], e["doc"], e["both"])))
        batch = np.searchsorted(np.array(cuts, np.int64), e["doc"], "left") if cuts else np.zeros(len(e["doc"]), np.int64)
        family, fresh, out = Family(), [], []
        family.levels = stood
        for b in range(len(cuts) + 1):
            new = _pick(e, np.flatnonzero(batch == b))
            first = np.ones(len(new["both"]), bool)
            first[1:] = new["both"][1:] != new["both"][:-1]
            old = family.known(new["both"]) if family.levels else np.zeros(len(first), bool)
            lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
            copy = old | (new["doc"] != new["doc"][lead]) | (new["at"] != new["at"][lead])
            c = _pick(new, copy)
            out.append((c["doc"], np.zeros(len(c["doc"]), "<u8"), c["at"], c["at"] + c["more"] + np.uint32(length)))
            fresh.append(_pick(new, np.flatnonzero(first & ~old)))
            family.add(fresh[-1])
        # Grams with several distinct runs: their windows are settled one by one.
        if family.levels:
            every = {k: np.concatenate([v[k] for v in family.levels]) for k in family.levels[0]}
            _, where, n = np.unique(every["gram"], return_inverse=True, return_counts=True)
            some = n[where] > 1
            if stood:
                # Grams without a new run were settled when they came.
                some &= np.isin(every["gram"], np.concatenate([f["gram"] for f in fresh]))
            o = _pick(every, np.flatnonzero(some))
            out.append((o["doc"], np.maximum(o["gram"], 1), o["at"], o["at"] + o["more"] + np.uint32(1)))
        columns = [np.concatenate(c).astype(t) for c, t in zip(zip(*out), SPAN.values())]
        found = pa.concat_tables([spans, pa.Table.from_batches([dealt(columns, _doc_key(columns[0]), parts)])])
        found = found.add_column(0, "kind", pa.array(np.ones(len(found), np.int32)))
        if keep and sum(len(f["both"]) for f in fresh):
            level = {k: np.concatenate([f[k] for f in fresh]) for k in fresh[0]}
            level = _pick(level, np.argsort(level["both"], kind="stable"))
            found = pa.concat_tables([found, pa.table({"kind": pa.array([3], pa.int32()), "part": pa.array([part], pa.int32()), "payload": pa.array([_bytes(level)], pa.binary())})])
        return found

    return run


@lean_group
def _by_document(key, table):
    """One row a document: its spans of duplicates and its open runs of windows, as (begin, end) pairs."""
    s = gathered(table.column("payload").to_pylist(), SPAN)
    s = _pick(s, np.lexsort((s["at"], s["doc"])))
    docs, begin = np.unique(s["doc"], return_index=True)
    pairs = np.stack([s["at"], s["end"]], 1)
    spans, opened = [], []
    for lo, hi in zip(begin, np.append(begin[1:], len(s["doc"]))):
        sure = s["gram"][lo:hi] == 0
        spans.append(pairs[lo:hi][sure].tobytes()), opened.append(pairs[lo:hi][~sure].tobytes())
    return pa.table({"doc_id": pa.array(docs), "spans": pa.array(spans, pa.binary()), "opened": pa.array(opened, pa.binary())})


def _windows(length: int, parts: int):
    """Fingerprints of single windows, dealt by fingerprint; copies within a task are spans at once."""

    @lean
    def run(batches):
        held, total = [], 0

        def flush():
            h, doc, at = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((at, doc, h))
            h, doc, at = h[order], doc[order], at[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            yield _tagged(dealt([h[first], doc[first], at[first]], mix(h[first]), parts), 0)
            yield from _copies(h, doc, at, first, length, parts)

        for batch in batches:
            for doc, text, base, opened in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                spans = within(opened, base, len(raw))
                for lo in range(0, len(raw), 1 << 20):
                    mine = spans[(spans[:, 1] > lo) & (spans[:, 0] < lo + (1 << 20))]
                    if not len(mine):
                        continue
                    mine = np.clip(mine, lo, lo + (1 << 20)) - lo
                    size = mine[:, 1] - mine[:, 0]
                    at = np.repeat(mine[:, 0] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                    part = raw[lo : lo + (1 << 20) + length]
                    sums, down = prefix_sums(mix(octets(part))), powers(len(part) + 1)[1]
                    held.append((mix((sums[at + length - WIDE + 1] - sums[at]) * down[at]), np.full(len(at), doc, "<i8"), (at + lo + base).astype("<u4")))
                    total += len(at)
                    if total >= 1 << 20:
                        yield from flush()
                        total = 0
        if held:
            yield from flush()

    return run


def _copies(h, doc, at, first, length: int, parts: int):
    """Windows behind the first of their kind as merged spans, dealt by document."""
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    copy = (doc != doc[lead]) | (at != at[lead])
    doc, at = doc[copy], at[copy]
    if len(doc):
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order].astype(np.int64)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(doc)) - 1
        yield _tagged(dealt([doc[begin], np.zeros(len(begin), "<u8"), at[begin].astype("<u4"), (at[last] + length).astype("<u4")], _doc_key(doc[begin]), parts), 1)


def _settle(length: int, parts: int):
    @lean_group
    def run(key, table):
        table, spans = _kinds(table)
        w = gathered(table.column("payload").to_pylist(), WINDOW)
        w = _pick(w, np.lexsort((w["at"], w["doc"], w["h"])))
        first = np.ones(len(w["h"]), bool)
        first[1:] = w["h"][1:] != w["h"][:-1]
        out = list(_copies(w["h"], w["doc"], w["at"], first, length, parts))
        return pa.concat_tables([spans, *[pa.Table.from_batches([b]).select(["part", "payload"]) for b in out]])

    return run


def within(spans: bytes, base: int, size: int) -> np.ndarray:
    """The spans that lie in a text of ``size`` bytes whose first has the number ``base``, as places in the text."""
    s = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64) - base
    return s[(s[:, 0] >= 0) & (s[:, 0] < size)]


def merged(s: np.ndarray) -> np.ndarray:
    """Sorted disjoint (begin, end) of some spans; touching ones are one."""
    s = s[np.argsort(s[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 1])
    new = np.ones(len(s), bool)
    new[1:] = s[1:, 0] > end[:-1]
    return np.stack([s[new, 0], end[np.append(np.flatnonzero(new)[1:], len(s)) - 1]], 1)


@lean
def _cut(batches):
    for batch in batches:
        rows = []
        for doc, text, base, spans in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode("utf-8", "surrogatepass")
            gone = merged(within(spans, base, len(raw)))
            edges = [0, *gone.reshape(-1).tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((doc, hashlib.sha256(raw).hexdigest(), int((gone[:, 1] - gone[:, 0]).sum()), gone.tolist(), hashlib.sha256(kept).hexdigest()))
        doc, sha, n, spans, kept = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(sha, pa.string()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())],
            names=["doc_id", "sha", "n_removed", "removed", "kept_sha256"],
        )


def _texts(docs: DataFrame, length: int, ws: Workspace, name: str) -> DataFrame:
    """``doc_id, text, base``: the texts that take part, each once, and the number of its first byte in its document.

    Different texts of one doc_id follow each other in order of their bytes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    again = ws.save(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), name)
    if again.isEmpty():
        return docs.withColumn("base", F.lit(0).cast("long"))
    several = docs.join(again, "doc_id", "left_semi").distinct()
    before = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("doc_id").orderBy("text").rowsBetween(Window.unboundedPreceding, -1))
    several = several.withColumn("base", F.coalesce(before, F.lit(0).cast("long")))
    return docs.join(again, "doc_id", "left_anti").withColumn("base", F.lit(0).cast("long")).unionByName(several)


def repeated_substrings(
    spark: SparkSession, docs: DataFrame, length: int = 100, batches: int = 4, part_bytes: int = 8 << 20, index: str | None = None, earlier: DataFrame | None = None, ws: Workspace | None = None
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, removed, kept_sha256`` for every row of ``docs(doc_id, text)``.

    ``removed``: sorted disjoint [begin, end) of the bytes covered by a
    ``length``-byte string that also starts earlier (smaller doc_id, or same
    document, earlier start).  Null and empty texts have 0 bytes and, like
    texts shorter than ``length``, lose nothing; so do rows of a null doc_id.
    Equal rows are one document; an id's different texts are one document too,
    in order of their bytes.  Very long texts are worked through in pieces;
    other columns are left out; an empty table gives no row.

    ``index``: a folder on shared storage.  What stands there from former runs
    (of other documents, of smaller ids, given as ``earlier(doc_id, text)``)
    counts as earlier, and these documents are added to it.
    """
    ws = ws or Workspace(spark, "suffix-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    compared = _texts(docs, length, ws, "again")
    shares = [i / batches for i in range(1, batches)]
    cuts = (compared.agg(F.percentile_approx("doc_id", shares, 10000)).first()[0] or []) if shares else []
    cuts = sorted(set(cuts))
    parts = part_count(spark, docs, part_bytes)
    family = Index(spark, index, parts) if index else None
    parts = family.parts if family else parts

    schema = "kind int, part int, payload binary"
    entries = compared.select("doc_id", "text", "base").mapInArrow(_entries(length, parts), schema)
    for i, level in enumerate(family.blobs() if family else ()):
        entries = entries.union(level.select(F.lit(2 + i).alias("kind"), "part", "payload"))
    scanned = entries.groupBy("part").applyInArrow(_scan(length, cuts, parts, family is not None), schema)
    if family:
        scanned = ws.save(scanned, "scanned")
    found = scanned.filter("kind = 1").groupBy("part").applyInArrow(_by_document, "doc_id long, spans binary, opened binary")
    found = ws.save(found, "found")

    known = compared.unionByName(_texts(earlier, length, ws, "again-earlier")) if earlier is not None else compared
    opened = found.filter("octet_length(opened) > 0").select("doc_id", "opened")
    texts = having(known, opened, more=("base",)).join(opened, "doc_id").select("doc_id", "text", "base", "opened")
    windows = texts.mapInArrow(_windows(length, parts), schema)
    copies = windows.groupBy("part").applyInArrow(_settle(length, parts), "part int, payload binary")
    more = copies.groupBy("part").applyInArrow(_by_document, "doc_id long, spans binary, opened binary")
    more = ws.save(more.select("doc_id", "spans"), "more")
    if family:
        family.add(scanned.filter("kind = 3").select("part", "payload"))

    sure = found.filter("octet_length(spans) > 0").select("doc_id", "spans")
    gone = sure.union(more).groupBy("doc_id").agg(F.collect_list("spans").alias("s"))
    gone = ws.save(gone.select("doc_id", F.aggregate("s", F.lit(b""), lambda a, b: F.concat(a, b)).alias("spans")), "gone")
    cut = having(compared, gone, more=("base",)).join(gone, "doc_id").select("doc_id", "text", "base", "spans")
    cut = cut.mapInArrow(_cut, "doc_id long, sha string, n_removed long, removed array<array<long>>, kept_sha256 string")
    cut = ws.save(cut, "cut")
    ws.drop("found", "more", "gone", "scanned")
    whole = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha")
    )
    out = whole.join(cut, ["doc_id", "sha"], "left")
    none = F.array().cast("array<array<long>>")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
