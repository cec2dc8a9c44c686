"""Vector operators: exact top-k by no-random-access aggregation, near-duplicates by p-stable hashing."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, components, lean

#: Candidates in a block of sorted lists; shares of the lists read in turn; survivors that are resolved at once; queries that read together.
BLOCK, DEPTHS, FEW, QUERIES = 8192, (1 / 8, 1 / 4, 1 / 2, 1), 64, 64
#: Scores between blocks are decimals of 38 digits, results are longs: both stop at their ends.
MOST, LONG = 10**38 - 1, 2**63


def sound(df: DataFrame) -> DataFrame:
    """Rows whose ``embedding`` is of finite components, with their number ``dims``."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole).withColumn("dims", F.size("embedding"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Lists:
    """The rows of a block in one list for each dimension, sorted by value, and the norms of the rows."""

    def __init__(self, vec_ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = vec_ids, values
        self.order = np.argsort(values.T, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)
        self.norms = (values**2).sum(1)
        self.peak = np.abs(values).max(initial=0)
        self.distinct = len(np.unique(vec_ids)) == len(vec_ids)
        #: Entries read and rows resolved so far.
        self.read = self.resolved = 0
        self.depths: list[tuple] = []

    def depth(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """What reading on to the i-th depth brings: its entries as rows of values (0 elsewhere), one column for each
        end of each list (first those read from the greatest value down), which entries are still open then, the
        values at both fronts, and how many entries of a list are read so far."""
        while len(self.depths) <= i:
            n, size = self.values.shape
            done = self.depths[-1][3] if self.depths else 0
            upto = min(n, max(done + 1, int(np.ceil(n * DEPTHS[len(self.depths)]))))
            new, open_ = np.zeros((n, 2 * size)), self.depths[-1][1].copy() if self.depths else np.ones((n, 2 * size), np.float32)
            for at, part in ((0, slice(n - upto, n - done)), (size, slice(done, upto))):
                rows, column = self.order[:, part], np.arange(size)[:, None]
                new[rows, column + at] = self.sorted[:, part]
                open_[rows, column + at] = 0
            self.depths.append((new, open_, np.concatenate([self.sorted[:, n - upto], self.sorted[:, upto - 1]]), upto))
        return self.depths[i]

    def best(self, query_id: int, w: np.ndarray, k: int) -> list[tuple[int, int]]:
        return self.best_of([query_id], w[None, :], k)[0]

    def best_of(self, query_ids, w: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """The k best (score, vec_id) for each query, ties to the smaller vec_id.

        Every list is read in turn from the end that a query's weight favours.
        Of a row, the entries read give a part of its score; the rest lies
        between what the lists' fronts and far ends allow, and within the
        product of the norms of what is unread of row and query.  A row stays
        while its upper bound reaches the k-th best lower bound.  What was
        never read is an outsider with nothing but the fronts' bound, so a
        query's reading ends when no outsider can qualify and few rows are left,
        whose final scores are resolved; or at the ends of the lists.  Queries
        of one block read the same depths, so a depth is one product of their
        weights with the entries that it brings.
        """
        out: list = [None] * len(w)
        top = np.abs(w).max(1, initial=0)
        for i in np.flatnonzero(self.peak * top * w.shape[1] >= 2**53):
            out[i] = self.exact(query_ids[i], w[i], k)
        left = np.array([i for i in range(len(w)) if out[i] is None], int)
        signs = np.hstack([w >= 0, w < 0])
        split = np.hstack([w, w]) * signs
        part = np.zeros((len(w), len(self.ids)))
        alive = [np.flatnonzero(self.ids != q) for q in query_ids]
        far = np.concatenate([self.sorted[:, 0], self.sorted[:, -1]])
        norms = np.sqrt(self.norms)
        seen = np.zeros((len(w), len(self.ids)))
        for d in range(len(DEPTHS)):
            if not len(left):
                break
            new, open_, front, upto = self.depth(d)
            part[left] += split[left] @ new.T
            self.read += int((w[left] != 0).sum()) * (upto - (self.depths[d - 1][3] if d else 0))
            last = upto == len(self.ids)
            if not last:
                # Bounds are taken in single precision; the slack covers what that loses.
                v = split[left]
                high, low, rest_w = ((m.astype(np.float32) @ open_.T) for m in (v * front, v * far, v * v))
                seen[left] += signs[left].astype(np.float32) @ (new.astype(np.float32) ** 2).T
                rest_x = self.norms * (1 + 1e-5) - seen[left] * (1 - 1e-5)
                weight = np.sqrt((v * v).sum(1))
                unread = np.sqrt(np.maximum(0, rest_w * (1 + 1e-5) + 1e-5 * weight[:, None] ** 2) * np.maximum(0, rest_x))
                slack = 1e-5 * (np.outer(weight, norms) + np.abs(v).sum(1)[:, None] * self.peak) + 1e-9
                upper = part[left] + np.minimum(high, unread) + slack
                lower = part[left] + np.maximum(low, -unread) - slack
            going = []
            for at, i in enumerate(left):
                rows = alive[i]
                sure, most = (part[i][rows],) * 2 if last else (lower[at][rows], upper[at][rows])
                alive[i] = rows = rows[most >= self.bar(rows, sure, k)]
                if last:
                    out[i] = self.first([int(x) for x in part[i][rows]], rows, k)
                elif len(rows) <= FEW:
                    self.resolved += len(rows)
                    out[i] = self.first([int(x) for x in self.values[rows] @ w[i]], rows, k)
                else:
                    going.append(i)
            left = np.array(going, int)
        return out

    def bar(self, rows: np.ndarray, lower: np.ndarray, k: int) -> float:
        """The k-th best lower bound; of several rows of one vec_id the best counts."""
        ids, at = (rows, None) if self.distinct else np.unique(self.ids[rows], return_inverse=True)
        if len(ids) < k:
            return -np.inf
        if len(ids) < len(rows):
            each = np.full(len(ids), -np.inf)
            np.maximum.at(each, at, lower)
            lower = each
        return np.partition(lower, len(lower) - k)[len(lower) - k]

    def exact(self, query_id: int, w: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Products too large for doubles, row by row in integers of any size."""
        q, rows = [int(x) for x in w], np.flatnonzero(self.ids != query_id)
        return self.first([max(-MOST, min(MOST, sum(a * int(b) for a, b in zip(q, self.values[r])))) for r in rows], rows, k)

    def first(self, scores: list[int], rows: np.ndarray, k: int) -> list[tuple[int, int]]:
        return sorted({(s, int(self.ids[r])) for s, r in zip(scores, rows)}, key=lambda x: (-x[0], x[1]))[:k]


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, block: int | None = None, ws: Workspace | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k greatest inner products of each query.

    ``vectors(vec_id, embedding)``; components become floor(scale * x).
    Queries are the rows whose vec_id ``every`` divides, candidates all rows
    of another vec_id and as many components; ties go to the smaller vec_id.
    Null and empty vectors, vectors with null or non-finite components and
    null vec_ids take no part; other columns are left out.  Rows that repeat
    an id and a vector count once.  Scores are exact integers; those beyond a
    long stop at its ends.  An empty table gives no row.

    Candidates are dealt into blocks of about ``block`` rows (``BLOCK``); queries travel
    to every block as rows, so no task or driver holds more than a block.
    """
    ws = ws or Workspace(spark, "top-k")
    rows = sound(vectors.select("vec_id", "embedding").filter("vec_id is not null"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "dims", F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")).alias("v")).distinct()
    rows = ws.save(rows, "vectors")
    blocks = max(1, -(-rows.count() // (block or BLOCK)))
    candidates = rows.select("dims", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = rows.filter(F.col("vec_id") % every == 0).select("dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "v")
    met = candidates.union(asked).repartition("dims", "block").sortWithinPartitions("dims", "block", "asks")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score decimal(38,0)")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    limit = [F.lit(str(x)).cast("decimal(38,0)") for x in (-LONG, LONG - 1)]
    return found.select("query_id", "rank", "vec_id", F.greatest(F.least("score", limit[1]), limit[0]).cast("long").alias("score"))


def _search(k: int):
    """Batches ``dims, block, asks, vec_id, v``: a block's candidates come before its queries."""

    @lean
    def search(batches):
        key, held, lists = None, [], None
        for batch in batches:
            dims, block, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            change = np.flatnonzero((np.diff(dims) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            out = []
            for lo, hi in zip([0, *change], [*change, len(batch)]):
                if lo == hi:
                    continue
                if key != (dims[lo], block[lo]):
                    key, held, lists = (dims[lo], block[lo]), [], None
                x = matrix(batch.column(4).slice(lo, hi - lo))
                if not asks[lo]:
                    held.append((ids[lo:hi], x))
                    continue
                if lists is None and held:
                    lists = Lists(np.concatenate([h[0] for h in held]), np.vstack([h[1] for h in held]))
                for at in range(lo, hi, QUERIES) if lists else ():
                    asked = slice(at, min(at + QUERIES, hi))
                    for query, best in zip(ids[asked], lists.best_of(ids[asked], x[asked.start - lo : asked.stop - lo], k)):
                        out += [(int(query), v, s) for s, v in best]
            q, v, s = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array([Decimal(x) for x in s], pa.decimal128(38, 0))], names=["query_id", "vec_id", "score"])

    return search


#: p-stable hashing: tables, projections a table, bucket width on unit vectors.
#: At cosine 0.95 (distance 0.316) one projection agrees with p = 0.874, so a pair is
#: found with p = 0.976 (0.999 at cosine 0.97).  At cosine 0 (distance 1.414) one agrees
#: with p = 0.486, all of a table with 2.3e-6.
TABLES, PROJECTIONS, WIDTH = 40, 18, 2.0
#: Buckets of up to SMALL rows give pairs of ids; larger ones are compared in pairs of blocks of about BUCKET rows.
SMALL, BUCKET = 16, 512
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Hashing:
    """``codes`` of unit vectors in all tables."""

    def __init__(self, tables: int, projections: int, width: float, seed: int):
        self.tables, self.projections, self.width, self.seed, self.known = tables, projections, width, seed, {}

    def codes(self, unit: np.ndarray) -> np.ndarray:
        dims = unit.shape[1]
        if dims not in self.known:
            rng = np.random.default_rng(self.seed)
            n = self.tables * self.projections
            self.known[dims] = rng.standard_normal((dims, n)), rng.uniform(0, self.width, n)
        a, b = self.known[dims]
        cells = np.floor((unit @ a + b) / self.width).astype(np.int64).astype(np.uint64).reshape(len(unit), self.tables, self.projections)
        h = np.zeros((len(unit), self.tables), np.uint64)
        for j in range(self.projections):
            h = (h ^ cells[:, :, j]) * MULTIPLY
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 (scaled first, so that no square overflows)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(hashing: Hashing):
    """``rep, t, code``: a row for each table; t tells numbers of components apart as well."""

    @lean
    def code(batches):
        for batch in batches:
            rep, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                codes = hashing.codes(units(matrix(batch.column(2).take(pa.array(mine)))))
                t = np.tile(d * hashing.tables + np.arange(hashing.tables), len(mine)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep[mine], hashing.tables)), pa.array(t), pa.array(codes.reshape(-1))], names=["rep", "t", "code"])

    return code


def meets_large(codes_a, codes_b, large_a, tables: int) -> np.ndarray:
    """First table in which both share a large bucket; ``tables`` if none."""
    equal = (codes_a == codes_b) & ((large_a[:, None] >> np.arange(tables)) & 1).astype(bool)
    return np.where(equal.any(1), equal.argmax(1), tables)


def linked(rep, links, a, b) -> pa.RecordBatch:
    """Counts (other = rep) and edges as one batch."""
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([rep[some], a])), pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([rep[some], b]))], names=["rep", "links", "other"]
    )


def _pair_links(least: float, hashing: Hashing):
    """Links among pairs ``a, b`` of ids, but for those that a large bucket compares."""

    @lean
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b, m_a, m_b, large = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "m_a", "m_b", "large_a"))
            dims = pa.compute.list_value_length(batch.column("x_a")).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                x, y = (units(matrix(batch.column(c).take(pa.array(mine)))) for c in ("x_a", "x_b"))
                new = meets_large(hashing.codes(x), hashing.codes(y), large[mine], hashing.tables) == hashing.tables
                near = mine[new & (np.einsum("ij,ij->i", x, y) >= least)]
                both = np.concatenate([a[near], b[near]])
                yield linked(both, np.concatenate([m_b[near], m_a[near]]), a[near], b[near])

    return run


def _bucket_links(least: float, hashing: Hashing):
    """Links of each (table, bucket, block pair) of large buckets; a pair counts in the first of them where it meets."""

    def compare(keys, rep, m, unit, codes, large, side):
        n = len(rep)
        links = np.zeros(n, np.int64)
        edges = []
        change = np.ones(n, bool)
        change[1:] = (keys[1:] != keys[:-1]).any(1)
        begin = np.flatnonzero(change)
        size = np.diff(np.append(begin, n))
        tables = keys[:, 0] % hashing.tables
        mixed = keys[:, 2] != keys[:, 3]

        def check(a, b):
            # In a pair of different blocks only rows of different sides meet.
            ok = ~mixed[a] | (side[a] != side[b])
            a, b = a[ok], b[ok]
            new = meets_large(codes[a], codes[b], large[a], hashing.tables) == tables[a]
            a, b = a[new], b[new]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
            a, b = a[near], b[near]
            np.add.at(links, a, m[b])
            np.add.at(links, b, m[a])
            return a, b

        for lo, hi in zip(begin, begin + size):
            found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in range(lo, hi, 256):
                a, b = np.nonzero(unit[r : r + 256][: hi - r] @ unit[lo:hi].T >= least - 1e-9)
                a, b = a + r, b + lo
                a, b = a[a < b], b[a < b]
                for pa_, pb_ in zip(np.array_split(a, 1 + len(a) // 65536), np.array_split(b, 1 + len(a) // 65536)):
                    x, y = check(pa_, pb_)
                    found[0].append(x), found[1].append(y)
            a, b = np.concatenate(found[0]) - lo, np.concatenate(found[1]) - lo
            # A star per local component says as much as all its links.
            root = np.arange(hi - lo)
            while len(a):
                low = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, a, low), np.minimum.at(root, b, low)
                root = root[root]
                if (root == before).all():
                    break
            own = np.flatnonzero(root != np.arange(hi - lo))
            edges.append((own + lo, root[own] + lo))
        a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
        return linked(rep, links, rep[a], rep[b])

    @lean
    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            keys = np.stack([held.column(i).to_numpy() for i in range(4)], 1)
            last = int(np.flatnonzero((keys != keys[-1]).any(1)).max(initial=-1)) + 1
            if last and len(held) >= 4096:
                yield from done(held.slice(0, last), keys[:last])
                held = held.slice(last).combine_chunks()
        if held is not None and len(held):
            yield from done(held, np.stack([held.column(i).to_numpy() for i in range(4)], 1))

    def done(t, keys):
        dims = keys[:, 0] // hashing.tables
        for d in np.unique(dims):
            mine = np.flatnonzero(dims == d)
            part = t.take(pa.array(mine))
            unit = units(matrix(part.column("x").combine_chunks()))
            yield compare(keys[mine], *(part.column(c).to_numpy() for c in ("rep", "m")), unit, hashing.codes(unit), *(part.column(c).to_numpy() for c in ("large", "side")))

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, least: float = 0.95, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 5, ws: Workspace | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Unit vectors fall into quantised random projections; rows that share a
    bucket of any table are compared by exact cosine, none linked below
    ``least``.  Equal vectors are one class with a multiplicity: its rows link
    with each other and with all rows of linked classes, and no copy is ever
    paired.  Buckets of few rows give pairs of ids, each pair once for all
    tables, and only then vectors travel; large buckets are split into block
    pairs, and a pair that meets in several of them counts in the first.

    Null, empty or zero vectors and those with null or non-finite components
    have 0 links and are their own component; vectors of different numbers of
    components never link.  Rows that repeat a vec_id are vectors of their
    own.  A null vec_id has no links.  Ties at ``least`` link; an empty table
    gives no row; other columns are left out.
    """
    ws = ws or Workspace(spark, "near-vectors")
    if tables > 62:
        raise ValueError("at most 62 tables: a long holds a bit for each")
    hashing = Hashing(tables, projections, width, seed)
    base = vectors.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64("embedding", F.lit(1)).alias("h2"))
    rows = sound(base).filter(F.exists("embedding", lambda x: x != 0)).filter("vec_id is not null")
    grouped = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m"), F.first("dims").alias("dims"), F.first("embedding").alias("embedding"))
    # A class goes by the first hash; the smallest vec_id comes in again at the end.
    classes = ws.save(grouped.withColumn("rep", F.col("h1")), "classes")
    entries = ws.save(classes.select("rep", "dims", "embedding").mapInArrow(_code(hashing), "rep long, t long, code int"), "entries")
    full = entries.groupBy("t", "code").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    full = ws.save(full.withColumn("blocks", F.ceil(F.col("c") / BUCKET).cast("int")), "buckets")

    together = entries.join(full.filter(F.col("c") <= SMALL), ["t", "code"]).groupBy("t", "code").agg(F.array_sort(F.collect_list("rep")).alias("reps"))
    pairs = F.transform(F.slice("reps", F.col("i") + 2, SMALL), lambda b: F.struct(F.get("reps", "i").alias("a"), b.alias("b")))
    pairs = together.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("reps") - 2))).select(F.explode(pairs).alias("p")).select("p.*").distinct()
    pairs = ws.save(pairs, "pairs")

    members = entries.join(full.filter(F.col("c") > SMALL), ["t", "code"]).withColumn("side", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int"))
    members = ws.save(members.select("rep", "t", "code", "blocks", "side"), "members")
    large = members.groupBy("rep").agg(F.bit_or(F.expr(f"shiftleft(1L, cast(t % {tables} as int))")).alias("large"))
    vector = classes.select("rep", "m", F.col("embedding").alias("x")).join(large, "rep", "left").withColumn("large", F.coalesce("large", F.lit(0).cast("long")))
    vector = ws.save(vector, "vectors")
    of = lambda s: vector.select(*[F.col(c).alias(n) for c, n in (("rep", s), ("m", f"m_{s}"), ("x", f"x_{s}"), ("large", f"large_{s}"))])
    met = pairs.join(of("a"), "a").join(of("b").drop("large_b"), "b")
    links = met.mapInArrow(_pair_links(least, hashing), "rep long, links long, other long")

    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("rep", "t", "code", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "side")
    met = members.join(vector, "rep").select("t", "code", "i", "j", "side", "rep", "m", "x", "large")
    met = met.repartition("t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j")
    links = ws.save(links.union(met.mapInArrow(_bucket_links(least, hashing), "rep long, links long, other long")), "links")
    counts = links.filter("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(ws, links.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    per_class = classes.select("h1", "h2", "rep", "first", "m").join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = ws.save(
        per_class.select("h1", "h2", "first", F.coalesce("component", "rep").alias("root"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "per-class"
    )
    smallest = ws.save(per_class.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    per_class = ws.save(per_class.join(smallest, "root").select("h1", "h2", "links", "component"), "named")
    linkable = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    out = base.withColumn("linkable", linkable).drop("embedding").join(per_class, ["h1", "h2"], "left")
    ws.drop("entries", "buckets", "pairs", "members", "vectors", "links", "per-class", "smallest", "classes")
    out = out.withColumn("links", F.when(F.col("linkable"), F.col("links"))).withColumn("component", F.when(F.col("linkable"), F.col("component")))
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
