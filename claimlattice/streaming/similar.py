"""Bursts of similar posts in a stream.

Each micro-batch's texts get MinHash bands; new texts meet earlier ones (and
each other) in bands, are held to their exact Jaccard similarity, and join
clusters that may merge.  Tables are written exactly once, so a replayed batch
changes nothing.  What links with what does not depend on how posts fall into
batches, so the clusters after all batches are those of one batch.

A text is kept once, as it came; its shingles, which take more room, are made
where they are compared.  Texts that share bands meet as sketches of a bit or
two for each shingle, which can only be too near to each other: what they
leave open makes families, and only texts of families travel, once for each
tile.  Of the pairs in a tile as many as join its texts are passed on, so rows
grow with the texts and not with the pairs among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matching import _mix, clusters, lean, short_batches, word_shingles
from ..session import checkpoint_folder
from .ledger import CODEC, KeyedTable, Log

#: 12 bands of 3: two texts of similarity 0.8 meet in one with a chance of 0.9998.
BANDS, ROWS = 12, 3
#: The odd factors that make ``BANDS * ROWS`` hashes of a shingle's fingerprint.
FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: Shingles that are hashed at once.
SLICE = 2048
#: Shingles whose sketches, and bytes of texts that make up a chunk; two chunks are a tile.
SKETCHED, WRITTEN = 1 << 24, 1 << 23
#: Bits of the filter that spares a shuffle the rows which a join would drop: 1 MB, whatever the number of keys.
FILTER_BITS = 1 << 23

DESCRIBED = T.StructType([T.StructField("set_id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One fingerprint for each band: of the least values that ``ROWS`` hashes give to a shingle."""
    least, product = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64), np.empty((len(FACTORS), SLICE), np.uint64)
    for at in range(0, len(shingles), SLICE):
        part = shingles[at : at + SLICE]
        least = np.minimum(least, np.multiply.outer(FACTORS, part, out=product[:, : len(part)]).min(axis=1))
    found = np.arange(BANDS, dtype=np.uint64)
    for row in _mix(least).reshape(BANDS, ROWS).T:
        found = _mix(found * np.uint64(3) + row)
    return found


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Bits, two for a shingle or more and a power of two of them: each the parity of the shingles that fall on it.

    Two sets differ in as many shingles as their sketches do in bits, or in more.
    """
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    place = (_mix(shingles + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def _folded(sketch: np.ndarray) -> np.ndarray:
    """Sketches (along the last axis) of half as many bits."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def _describer(words: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for text in texts:
                s = word_shingles(text.as_py().encode() if text.is_valid else b"", words)
                # A set's id is a fingerprint of its shingles, whatever batch it comes in.
                set_id = _mix(np.add.reduce(_mix(s + np.uint64(3)), keepdims=True) + np.uint64(len(s))).view(np.int64)
                out.append({"set_id": int(set_id[0]), "n": len(s), "bands": bands_of(s).view(np.int64), "sketch": sketch_of(s).tobytes()} if len(s) else {})
            yield pa.array(out, pa.struct([("set_id", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]))

    return F.arrow_udf(lean(run), DESCRIBED)


def screened(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among ``keys``; a join drops those that are not.  With very many keys all rows pass."""
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:
        bits[r["w"]] = r["bits"]

    def run(slots: pa.Array) -> pa.Array:
        s = slots.to_numpy(zero_copy_only=False)
        return pa.array(((bits[s >> 6] >> (s & 63)) & 1).astype(bool))

    return rows.filter(F.arrow_udf(run, T.BooleanType())(slot))


def in_tiles(rows: DataFrame, group: str, amount: str, most: int) -> DataFrame:
    """``rows`` for each tile of their group: ``low, high`` (its chunks) and ``chunk`` (the row's own).

    A group is cut into chunks of about ``most`` of ``amount`` together, and
    any two chunks, or one and itself, are a tile.
    """
    chunks = F.ceil(F.sum(amount).over(Window.partitionBy(group)) / F.lit(most)).cast("long")
    rows = rows.withColumn("_chunks", F.greatest(chunks, F.lit(1).cast("long"))).withColumn("chunk", F.pmod(F.xxhash64("set_id"), "_chunks"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    return rows.withColumn("low", F.least("chunk", "_other")).withColumn("high", F.greatest("chunk", "_other")).drop("_chunks", "_other")


def _groups(batches, keys: int):
    """The rows of each value of the first columns, by which batches are sorted."""
    held, last = [], None
    for batch in batches:
        k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            if lo == hi:
                continue
            now = tuple(k[lo])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


class _Sketches:
    """Sketches of a tile by their lengths, each length also folded for the next shorter one."""

    def __init__(self, sketches: list[np.ndarray]):
        self.length = np.array([len(s) for s in sketches])
        self.row = np.zeros(len(sketches), np.int64)
        self.own, self.half = {}, {}
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.row[at] = np.arange(len(at))
            self.own[n] = np.stack([sketches[i] for i in at])
            self.half[n] = _folded(self.own[n])

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bits in which ``others``, of sizes that are alike, differ from i."""
        n, out = int(self.length[i]), np.zeros(len(others), np.int64)
        for m, theirs, own in ((n, self.own, self.own), (2 * n, self.half, self.own), (n // 2, self.own, self.half)):
            if m and len(at := np.flatnonzero(self.length[others] == m)):
                out[at] = np.bitwise_count(theirs[m][self.row[others[at]]] ^ own[n][self.row[i]]).sum(axis=1)
        return out


def _joined(label: np.ndarray, fresh: np.ndarray, chunk: np.ndarray | None, n: np.ndarray, least: float, meets: Callable, sketches: _Sketches, alike: Callable | None):
    """Pairs (i, j) that join what ``label`` keeps apart; as many as joins are, not as pairs.

    A pair has a new set and, if ``chunk`` is given, sets of two chunks; it
    ``meets`` in a band, and the sizes and sketches allow it to be alike.
    """
    for i in range(len(label) - 1):
        j = np.arange(i + 1, len(label))
        able = (label[j] != label[i]) & (fresh[j] | fresh[i]) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]) - 1e-9)
        j = j[able if chunk is None else able & (chunk[j] != chunk[i])]
        j = j[meets(i, j)] if len(j) else j
        if not len(j):
            continue
        apart = sketches.apart(i, j)
        near = apart <= (n[i] + n[j]) * ((1 - least) / (1 + least)) + 1e-9
        # The nearest first: once they are joined, the others of their cluster need no look.
        for k in j[near][np.argsort(apart[near], kind="stable")].tolist():
            if label[k] != label[i] and (alike is None or alike(i, k)):
                yield i, k
                label[label == label[k]] = label[i]


def _columns(tile: pa.Table, *names: str):
    for name in names:
        column = tile.column(name).combine_chunks()
        yield column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if name == "bands" else column.to_numpy(zero_copy_only=False)


def _edges(ids: np.ndarray, pairs) -> pa.RecordBatch:
    at = np.array(list(pairs), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])


def _open(least: float):
    """Tiles ``band, low, high, chunk, place, set_id, n, fresh, bands, sketch`` become ``a, b``: pairs that may be alike, as far as they join what else is apart.

    A pair belongs to the first band that its sets share.
    """

    @lean
    def run(batches):
        for tile in _groups(batches, 3):
            ids, place, n, fresh, bands, chunk = _columns(tile, "set_id", "place", "n", "fresh", "bands", "chunk")
            before = int(place[0])
            meets = lambda i, j: ~(bands[j, :before] == bands[i, :before]).any(axis=1)  # noqa: E731, B023
            crossing = chunk if tile.column("low")[0] != tile.column("high")[0] else None
            sketches = _Sketches([np.frombuffer(s, np.uint64) for s in tile.column("sketch").to_pylist()])
            yield _edges(ids, _joined(np.arange(len(ids)), fresh, crossing, n, least, meets, sketches, None))

    return run


def _alike(least: float, words: int):
    """Tiles ``family, low, high, chunk, set_id, cluster, fresh, bands, t`` become ``a, b``: pairs with Jaccard >= ``least``, as far as they join clusters."""

    @lean
    def run(batches):
        for tile in _groups(batches, 3):
            ids, cluster, fresh, bands, chunk = _columns(tile, "set_id", "cluster", "fresh", "bands", "chunk")
            sets = [word_shingles(t.as_py().encode(), words) for t in tile.column("t")]
            n = np.array([len(s) for s in sets])
            meets = lambda i, j: (bands[j] == bands[i]).any(axis=1)  # noqa: E731, B023
            crossing = chunk if tile.column("low")[0] != tile.column("high")[0] else None

            def alike(i: int, j: int) -> bool:
                at = np.searchsorted(sets[i], sets[j])  # noqa: B023
                both = int((sets[i][np.minimum(at, n[i] - 1)] == sets[j]).sum())  # noqa: B023
                return both >= least * (int(n[i]) + int(n[j]) - both)  # noqa: B023

            label = np.unique(cluster, return_inverse=True)[1].copy()
            yield _edges(ids, _joined(label, fresh, crossing, n, least, meets, _Sketches([sketch_of(s) for s in sets]), alike))

    return run


class SimilarPosts:
    """Clusters of alike posts over all batches so far.

    Texts of no words are in no cluster; of an id that comes again the first
    batch's text holds (within a batch the least).
    """

    def __init__(self, spark: SparkSession, folder: str, least: float = 0.8, words: int = 5):
        self.spark, self.least, self.words, self.folder = spark, least, words, folder
        field = lambda **c: T.StructType([T.StructField(n, t) for n, t in c.items()])
        log = lambda name, **c: Log(spark, f"{folder}/{name}", field(**c))
        described = {f.name: f.dataType for f in DESCRIBED}
        #: Rows as they came; all else refers to them.
        self.arrived = log("arrived", id=T.LongType(), at=T.TimestampType(), text=T.StringType(), bytes=T.LongType(), **described)
        self.posts = log("posts", id=T.LongType(), set_id=T.LongType(), at=T.TimestampType())
        #: Each set of shingles once, with the smallest id that it came with.
        self.sets = log("sets", set_id=T.LongType(), id=T.LongType(), bytes=T.LongType(), n=T.IntegerType(), bands=T.ArrayType(T.LongType()))
        self.members = KeyedTable(spark, f"{folder}/members", field(set_id=T.LongType(), cluster=T.LongType()), ["set_id"])

    def add(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch of ``id, text, at``.  Every table has its own ledger, so a batch that broke off goes on where it stood."""
        if self.members.has(batch):
            return
        checkpoint_folder(self.spark)
        for session in (self.spark, rows.sparkSession):
            short_batches(session)
        described = rows.filter("id is not null").select("id", "at", "text", F.octet_length("text").cast("long").alias("bytes"), _describer(self.words)(F.lower("text")).alias("d"))
        self.arrived.put(described.select("id", "at", "text", "bytes", "d.*"), batch)
        mine = self.arrived.get(batch, batch)
        self.posts.put(self._chosen(mine).join(self.posts.get(last=batch - 1).select("id"), "id", "left_anti"), batch)
        first = self.posts.get(batch, batch).groupBy("set_id").agg(F.min("id").alias("id")).join(self.sets.get(last=batch - 1).select("set_id"), "set_id", "left_anti")
        self.sets.put(first.join(mine.select("set_id", "id", "bytes", "n", "bands"), ["set_id", "id"]).dropDuplicates(["set_id"]), batch)

        # Links join what were clusters before; each cluster keeps its smallest set.
        old = self.members.get()
        alone = self.sets.get(batch, batch).select("set_id", F.col("set_id").alias("cluster"))
        before = self._saved(old.unionByName(alone), batch, "before")
        links = self._links(before, batch)
        ends = links.join(before.select(F.col("set_id").alias("a"), F.col("cluster").alias("ca")), "a").join(before.select(F.col("set_id").alias("b"), F.col("cluster").alias("cb")), "b")
        merged = clusters(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("cluster"), F.col("cluster").alias("into"))
        changed = before.join(merged, "cluster").filter("cluster <> into").select("set_id", F.col("into").alias("cluster"))
        kept = alone.join(changed.select("set_id"), "set_id", "left_anti")
        # Last, as it is what ends a batch.
        self.members.put(changed.unionByName(kept), batch)
        self._drop(batch)

    def _chosen(self, mine: DataFrame) -> DataFrame:
        """``id, set_id, at`` of the row that holds for each id of a batch, but for texts of no words."""
        by_id = mine.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("set_id", "at")).alias("x"))
        chosen = by_id.filter("rows = 1").select("id", "x.*")
        again = by_id.filter("rows > 1").select("id")
        if not again.isEmpty():
            least = screened(mine.select("id", "text", "at", "set_id"), again, "id").join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("text", "at", "set_id")).alias("x"))
            chosen = chosen.unionByName(least.select("id", "x.set_id", "x.at"))
        return chosen.filter("set_id is not null")

    def _links(self, before: DataFrame, batch: int) -> DataFrame:
        """``a, b``: alike sets, one of them new, as far as they join clusters."""
        sets = self.sets.get(last=batch - 1).withColumn("fresh", F.lit(False)).unionByName(self.sets.get(batch, batch).withColumn("fresh", F.lit(True)))
        kept = lambda column: self.arrived.get(last=batch).select("set_id", "id", column)
        bucket = Window.partitionBy("band")
        met = sets.select("set_id", "n", "fresh", F.posexplode("bands").alias("place", "band"))
        met = met.withColumn("_sets", F.count(F.lit(1)).over(bucket)).withColumn("_new", F.max("fresh").over(bucket)).filter("_sets > 1 and _new")
        met = self._saved(met.select("band", "place", "set_id", "n"), batch, "met")
        nodes = self._saved(sets.join(met.select("set_id").distinct(), "set_id", "left_semi"), batch, "nodes")

        sketched = screened(kept("sketch"), nodes, "id").join(nodes.select("set_id", "id", "fresh", "bands"), ["set_id", "id"]).drop("id")
        tiles = in_tiles(met, "band", "n", SKETCHED).join(sketched, "set_id").select("band", "low", "high", "chunk", "place", "set_id", "n", "fresh", "bands", "sketch")
        tiles = tiles.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
        families = clusters(tiles.mapInArrow(_open(self.least), "a long, b long")).select(F.col("node").alias("set_id"), F.col("cluster").alias("family"))

        related = self._saved(nodes.join(families, "set_id").join(before, "set_id"), batch, "related")
        texts = screened(kept("text"), related, "id")
        tiles = in_tiles(related, "family", "bytes", WRITTEN).join(texts, ["set_id", "id"]).select("family", "low", "high", "chunk", "set_id", "cluster", "fresh", "bands", F.lower("text").alias("t"))
        tiles = tiles.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
        return self._saved(tiles.mapInArrow(_alike(self.least, self.words), "a long, b long"), batch, "links")

    def _saved(self, rows: DataFrame, batch: int, name: str) -> DataFrame:
        """Writes and rereads what only this batch needs."""
        path = f"{self.folder}/work/{batch}/{name}"
        rows.write.mode("overwrite").option("compression", CODEC).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _drop(self, batch: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/work/{batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clusters(self) -> DataFrame:
        """``id, cluster``: the smallest id of the cluster; posts that no other is like are their own."""
        named = self.posts.get().join(self.members.get(), "set_id")
        first = named.groupBy("cluster").agg(F.min("id").alias("first"))
        return named.join(first, "cluster").select("id", F.col("first").alias("cluster"), "at")

    def bursts(self, length: str, at_least: int) -> DataFrame:
        """``cluster, window, n`` of windows in which a cluster has at least so many posts."""
        by = self.clusters().groupBy("cluster", F.window("at", length).alias("window"))
        return by.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)


def follow(posts: DataFrame, state: SimilarPosts, checkpoint: str) -> None:
    """Runs a stream of ``id, text, at`` over all that is there."""
    writer = posts.writeStream.foreachBatch(lambda rows, n: state.add(rows, n))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
