"""N-gram Jaccard join by set relations, and its components.

A document's set holds the fingerprints of its distinct word shingles.  Two
sets with Jaccard >= t share at least l tokens among the first
|x| - ceil(t|x|) + l in any one order of all tokens, so only these prefixes are
indexed; l is 1 + |x| / 20 (the smaller of two).  The order is
by frequency class (rare first), then by fingerprint; the class comes from a
sketch of fixed size that counts every token of every document, so tokens of
passages that many documents share stand last and make no lists.

Index level: a list is sorted by set size and walked from each entry; the walk
ends at the first partner out of size range, and partners at a position so
different that the tokens before and behind it cannot make up the overlap
needed are skipped.  Lists of up to ``SHORT`` entries give pairs, which go on
only if they can meet in l lists; sets in too few long lists to meet others
there alone leave these.  Chance meetings end here.

Answer level: entries of a long list are never paired with each other.  Within
windows of two neighbouring size classes, in one of which every two sets in
size range are together, all are compared with the most central set r (the one
whose prefix tokens the most other sets share).  Those that link with r are one
component and need no answers among each other.  For a set x that does not,
|x & y| <= min(|x & r|, |y & r|) + min(|x - r|, |y - r|) rules out most partners
y, and only where some stay open are blocks of texts compared.

A list is no single task: keys that one task meets often skip the dealing to
parts, hubs are a partial aggregate, and their joins can be split.

All sets that equal each other are one node, so copies are never paired.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import dealt, gathered, having, part_count
from .common import Workspace, components, lean, lean_group
from .hashing import mix, shingles, slabs, texts_of

#: The frequency sketch: counters, and rows into which they are cut on the way.
BINS, CHUNKS = 1 << 20, 64
#: Lists up to this length give pairs, longer ones groups.
SHORT = 4
#: Entries of one key in one task from which on they go straight into the list.
HOT = 32
#: Members and tokens of one block of a group.
BLOCK, BLOCK_TOKENS = 512, 1 << 18
#: Members that one task compares with a hub; a larger group goes to several.
STAR = 256
LIST = {"tok": "<u8", "node": "<i8", "n": "<u4", "pos": "<u4"}


def token_sets(texts: list[bytes], k: int):
    """The set (sorted, distinct fingerprints) of every text."""
    for part in slabs([len(t) for t in texts]):
        flat, bounds, _ = shingles(texts[part], k, True)
        for i in range(len(bounds) - 1):
            yield np.unique(flat[bounds[i] : bounds[i + 1]])


def node_of(tokens: np.ndarray) -> int:
    """A fingerprint of a set as a signed 64-bit number."""
    h = int(mix(tokens).sum(dtype=np.uint64)) ^ int(mix(tokens ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)) * 3
    h = int(mix(np.array([(h + len(tokens)) & (2**64 - 1)], np.uint64))[0])
    return h - 2**64 if h >= 2**63 else h


def _profile(k: int):
    """Per document its node and size; per task its counts for the sketch."""

    @lean
    def run(batches):
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            nodes, sizes = [], []
            for tokens in token_sets(texts_of(batch.column(1)), k):
                nodes.append(node_of(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
                # One document holds a token once, so a plain bincount of sorted bins is exact.
                bins, n = np.unique((tokens >> np.uint64(44)).astype(np.int64), return_counts=True)
                counts[bins] += n
            m = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["doc_id", "node", "n", "chunk", "counts"]
            )
        if counts.any():
            rows = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, CHUNKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array(rows, pa.binary())],
                names=["doc_id", "node", "n", "chunk", "counts"],
            )

    return run


@lean
def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["chunk", "counts"])


def frequency_classes(profile: DataFrame) -> np.ndarray:
    """A byte for each counter: quarter powers of 2 above the counters' median."""
    rows = profile.filter("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk")
    counts = np.zeros((CHUNKS, BINS // CHUNKS), np.int64)
    for r in rows.mapInArrow(_add_up, "chunk int, counts binary").collect():
        counts[r["chunk"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    counts = counts.reshape(-1)
    # Most counters hold rare tokens only; what stands out of their spread is frequent.
    usual = np.median(counts)
    over = (counts - usual) / (8 * np.sqrt(usual + 1) + 8)
    return np.clip(np.floor(4 * np.log2(np.maximum(over, 1))) + (over > 1), 0, 255).astype(np.uint8)


def least_overlap(n, percent: int):
    """Overlap that a set of n tokens has with any set it links with."""
    return -(-percent * n // 100)


def needed(n, m, percent: int):
    """Least i with 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def met(n):
    """Least number of lists in which a set of n tokens meets any set it links with."""
    return 1 + n // 20


def _prefixes(k: int, percent: int, classes: np.ndarray, parts: int):
    @lean
    def run(batches):
        seen: set[int] = set()
        held: list[tuple] = []
        total = 0

        def flush():
            size = [len(h[0]) for h in held]
            tok = np.concatenate([h[0] for h in held])
            node, n = (np.repeat(np.array([h[i] for h in held], t), size) for i, t in ((1, "<i8"), (2, "<u4")))
            pos = np.concatenate([np.arange(m, dtype="<u4") for m in size])
            held.clear()
            return dealt_lists({"tok": tok, "node": node, "n": n, "pos": pos}, mix(tok), parts)

        for batch in batches:
            for tokens in token_sets(texts_of(batch.column(0)), k):
                n = len(tokens)
                first = min(n, n - least_overlap(n, percent) + met(n))
                # A set too small to lose a token links with its equals only.
                if not n or 100 * n < percent * (n + 1):
                    continue
                node = node_of(tokens)
                if node in seen:
                    continue
                seen.add(node)
                rank = (classes[(tokens >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
                order = np.lexsort((tokens, rank))[:first] if n < 64 else _first(rank, tokens, first)
                held.append((tokens[order], node, n))
                total += first
                if total >= 1 << 18:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return run


def dealt_lists(entries: dict[str, np.ndarray], key: np.ndarray, parts: int):
    """Batches ``tok, node, n, part, payload``: entries dealt into parts, those of keys that are hot here as rows.

    One entry of a hot key is dealt as well, with a mark on its size, so that entries of other tasks
    find themselves in a long list.
    """
    order = np.argsort(entries["tok"], kind="stable")
    tok = entries["tok"][order]
    start = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
    size = np.diff(np.append(start, len(tok)))
    hot = np.repeat(size > HOT, size)
    deal = ~hot
    deal[start] = True
    pick = order[deal]
    marked = entries | {"n": np.where(np.isin(np.arange(len(tok)), order[start[size > HOT]]), entries["n"] | MARK, entries["n"])}
    out = dealt([c[pick] for c in marked.values()], key[pick], parts)
    m = len(out)
    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *out.columns], names=LISTED)
    pick = order[hot]
    if m := len(pick):
        rows = [pa.array(entries["tok"][pick].view(np.int64)), pa.array(entries["node"][pick]), pa.array(entries["n"][pick].astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*rows, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=LISTED)


LISTED = ["tok", "node", "n", "part", "payload"]
MARK = np.uint32(1 << 31)


def lists_of(table: pa.Table, kind: dict[str, str]) -> tuple[dict, np.ndarray, np.ndarray]:
    """Entries of a part sorted by key, size and node, each node once a key; length of each one's list; whether it is marked."""
    c = gathered(table.column("payload").to_pylist(), kind)
    marked, c["n"] = c["n"] >= MARK, c["n"] & ~MARK
    order = np.lexsort((~marked, c["node"], c["n"], c["tok"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["tok"][1:] != c["tok"][:-1]) | (c["node"][1:] != c["node"][:-1])
    c, marked = {k: v[new] for k, v in c.items()}, marked[order][new]
    start = np.ones(len(marked), bool)
    start[1:] = c["tok"][1:] != c["tok"][:-1]
    begin = np.flatnonzero(start)
    size = np.diff(np.append(begin, len(marked)))
    return c, np.repeat(size, size), np.repeat(np.logical_or.reduceat(marked, begin) if len(begin) else marked, size)


def _first(rank: np.ndarray, tokens: np.ndarray, first: int) -> np.ndarray:
    near = np.flatnonzero(rank <= np.partition(rank, first - 1)[first - 1])
    return near[np.lexsort((tokens[near], rank[near]))][:first]


def reachable(n_a, pos_a, n_b, pos_b, percent: int):
    """Whether sets of these sizes with a common token at these positions can have the overlap needed."""
    most = np.minimum(pos_a, pos_b) + 1 + np.minimum(n_a - pos_a - 1, n_b - pos_b - 1)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (most >= needed(n_a, n_b, percent))


def _lists(percent: int):
    """Pairs of short lists with the times they met here (tok null), and rows of long lists."""

    @lean_group
    def run(key, table):
        c, length, hot = lists_of(table, LIST)
        tok, node, n, pos = c["tok"], c["node"], c["n"].astype(np.int64), c["pos"].astype(np.int64)
        left, right, least = [], [], []
        at = np.flatnonzero((length > 1) & (length <= SHORT) & ~hot)
        step = 1
        while len(at):
            # All walks take a step; they end with the list or at the first set too large.
            at = at[at + step < len(tok)]
            at = at[(tok[at] == tok[at + step]) & (100 * n[at] >= percent * n[np.minimum(at + step, len(tok) - 1)])]
            a = at[reachable(n[at], pos[at], n[at + step], pos[at + step], percent)]
            left.append(np.minimum(node[a], node[a + step])), right.append(np.maximum(node[a], node[a + step])), least.append(n[a])
            step += 1
        none = np.zeros(0, np.int64)
        pairs, first, times = np.unique(np.stack([np.concatenate([none, *left]), np.concatenate([none, *right])], 1), axis=0, return_index=True, return_counts=True)
        long, k = (length > SHORT) | hot & (length > 1), len(pairs)
        m = int(long.sum())
        return pa.table(
            {
                "tok": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(tok[long].view(np.int64))]),
                "node": np.concatenate([pairs[:, 0], node[long]]),
                "n": np.concatenate([np.concatenate([none, *least])[first], n[long]]),
                "other": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(m, pa.int64())]),
                "times": pa.concat_arrays([pa.array(times.astype(np.int64)), pa.nulls(m, pa.int64())]),
            }
        )

    return run


def overlaps(hub: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Tokens that each of some sorted sets shares with the hub."""
    return np.array([int((hub[np.minimum(np.searchsorted(hub, s), len(hub) - 1)] == s).sum()) for s in sets], np.int64)


def stars(percent: int, sets_of):
    """``hub, node, n, o, linked``: every member of a group against its hub, which comes first.

    Batches hold ``hub, i, node, member, text``; ``sets_of`` gives the node and
    the set of each of some texts.  One set is held at a time: the hub's.
    """

    @lean
    def run(batches):
        key, hub = None, None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            nodes, member = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for i, (node, tokens) in enumerate(sets_of(texts_of(batch.column(4)))):
                # Rows of an id with another text than the class's have another node.
                if node != nodes[i]:
                    continue
                if not member[i]:
                    key, hub = keys[i], tokens
                elif keys[i] == key:
                    o, n = int(overlaps(hub, [tokens])[0]), len(tokens)
                    out.append((key[0], node, n, o, 100 * o >= percent * (len(hub) + n - o)))
            columns = zip(*out) if out else ((),) * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["hub", "node", "n", "o", "linked"])

    return run


def block_links(sets: list[np.ndarray], o: np.ndarray, far: np.ndarray, percent: int) -> np.ndarray:
    """A smallest number of its component for each set of a block of a group: links of ``far`` sets with any.

    ``o``: overlaps with the group's hub, which bound those of two members.
    """
    n, root = np.array([len(s) for s in sets]), np.arange(len(sets))
    far = np.flatnonzero(far)
    need = needed(n[far][:, None], n[None, :], percent)
    most = np.minimum(o[far][:, None], o[None, :]) + np.minimum((n - o)[far][:, None], (n - o)[None, :])
    open_ = (most >= need) & (far[:, None] != np.arange(len(sets))[None, :])
    if not open_.any():
        return root
    some = far[open_.any(1)]
    used = np.union1d(np.flatnonzero(open_.any(0)), some)
    at = np.full(len(sets), -1)
    at[used] = np.arange(len(used))
    tokens, column, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), n[used])
    shared = np.flatnonzero(times > 1)
    place = np.full(len(tokens), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    both = np.zeros((len(some), len(used)), np.float32)
    for lo in range(0, len(shared), 2048):
        a, b = np.searchsorted(column, (lo, lo + 2048))
        dense = np.zeros((len(used), min(2048, len(shared) - lo)), np.float32)
        dense[row[a:b], column[a:b] - lo] = 1
        both += dense[at[some]] @ dense.T
    x, y = np.nonzero((both >= need[open_.any(1)][:, used]) & open_[open_.any(1)][:, used])
    x, y = some[x], used[y]
    while len(x):
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low), np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low), np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def blocks(percent: int, sets_of):
    """Stars of the components of each block of a group.

    Batches hold ``hub, i, j, node, far, o, text``.
    """

    @lean
    def run(batches):
        held: dict = {"key": None, "rows": {}}

        def done():
            rows = list(held["rows"].items())
            if len(rows) > 1:
                nodes = np.array([r[0] for r in rows])
                o, far, sets = zip(*[r[1] for r in rows])
                root = block_links(list(sets), np.array(o), np.array(far), percent)
                own = np.flatnonzero(root != np.arange(len(root)))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            nodes, far, o = (batch.column(c).to_pylist() for c in range(3, 6))
            for i, (node, tokens) in enumerate(sets_of(texts_of(batch.column(6)))):
                if node != nodes[i]:
                    continue
                if keys[i] != held["key"]:
                    yield from done()
                    held |= {"key": keys[i], "rows": {}}
                was = held["rows"].get(node)
                held["rows"][node] = (o[i], far[i] or bool(was and was[1]), tokens)
        yield from done()

    return run


def windows(percent: int):
    """Both windows of a set of size n: two in size range (n <= m <= 100 n / percent) have one in common."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(100 / percent)) * 1.000000001))
    return F.explode(F.array(size_class, size_class + 1))


def hub_pairs(ws: Workspace, lists: DataFrame, percent: int, in_lists, least=1) -> DataFrame:
    """``hub, node``: which sets of lists ``lists(tok, node, n)`` are to be compared with which hub.

    ``in_lists``: the number of lists that a set (of size n) can be in, so that
    the share of those it is in tells how central it is; sets in fewer than
    ``least`` stay out.  Sets in size range are in one size class or in
    neighbouring ones, so each list has a hub for every two neighbouring classes.
    """
    stats = lists.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    stats = ws.save(stats.filter(F.col("c") >= least).select("node", (F.col("c") / in_lists).alias("central")), "central")
    rows = lists.join(stats, "node").withColumn("w", windows(percent)).select("tok", "w", "node", "n", "central")
    rows = ws.save(rows, "list-rows")
    hubs = rows.groupBy("tok", "w").agg(F.max(F.struct("central", "node", "n")).alias("h"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    hubs = ws.save(hubs.filter("lo <> hi").select("tok", "w", F.col("h.node").alias("hub")), "hubs")
    return rows.join(hubs, ["tok", "w"]).filter("node <> hub").select("hub", "node").distinct()


#: Tables that a comparison of groups leaves.
GROUP_TABLES = ("central", "list-rows", "hubs", "groups", "group-sizes", "star-members", "stars", "bounds", "open", "block-sizes", "block-members", "block-links")


def group_links(ws: Workspace, pairs: DataFrame, percent: int, fetch, sets_of) -> DataFrame:
    """Links ``a, b`` that say which members of groups ``pairs(hub, node)`` are in one component.

    ``fetch`` adds a column ``text`` to rows with a column ``node``.  Each member travels to its hub once (hubs of
    large groups to several tasks); those that do not link with it meet in
    blocks whatever its overlap with both does not rule out.
    """
    pairs = ws.save(pairs, "groups")
    counts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    counts = ws.save(counts, "group-sizes")
    member = pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"), "node")
    own = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("hub").alias("node"))
    texts = fetch(ws.save(member.union(own), "star-members"))
    texts = texts.select("hub", "i", "node", (F.col("hub") != F.col("node")).alias("member"), "text")
    texts = texts.repartition("hub", "i").sortWithinPartitions("hub", "i", "member", "node")
    star = ws.save(texts.mapInArrow(stars(percent, sets_of), "hub long, node long, n long, o long, linked boolean"), "stars")
    links = star.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))

    # Partners of sets that are far from their hub, in windows of two size classes.
    rows = star.withColumn("r", F.col("n") - F.col("o")).withColumn("w", windows(percent))
    most = [f(F.when(c, F.col(v))).alias(f"{p}_{v}") for p, c in (("far", ~F.col("linked")), ("any", F.lit(True))) for v, f in (("o", F.max), ("r", F.max), ("n", F.min))]
    bounds = rows.groupBy("hub", "w").agg(*most, F.count(F.lit(1)).alias("m"), F.count_if(~F.col("linked")).alias("f")).filter("f > 0 and m > 1")
    bounds = ws.save(bounds, "bounds")

    def open_with(p):
        best = F.least("o", f"{p}_o") + F.least("r", f"{p}_r")
        return best * (100 + percent) >= percent * (F.col("n") + F.col(f"{p}_n"))

    rows = rows.join(bounds, ["hub", "w"]).filter(open_with("far") | ~F.col("linked") & open_with("any"))
    rows = ws.save(rows.select("hub", "w", "node", "n", "o", (~F.col("linked") & open_with("any")).alias("far")), "open")
    if rows.isEmpty():
        ws.drop("open")
        return links
    few = F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_TOKENS) / F.max("n"))))
    dealt_ = rows.groupBy("hub", "w").agg(F.ceil(F.count_if("far") / few).cast("int").alias("fars"), F.ceil(F.count(F.lit(1)) / few).cast("int").alias("parts")).filter("fars > 0")
    rows = rows.join(ws.save(dealt_, "block-sizes"), ["hub", "w"])
    slot = lambda by, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    side = rows.withColumn("i", every("fars")).withColumn("j", slot("parts", 1)).withColumn("far", F.lit(False))
    far = rows.filter("far").withColumn("i", slot("fars", 2)).withColumn("j", every("parts"))
    key = F.struct("hub", "w")
    met = side.unionByName(far).groupBy(key.alias("key"), "i", "j", "node").agg(F.max("far").alias("far"), F.max("o").alias("o"))
    met = ws.save(met.select(F.xxhash64("key").alias("group"), "i", "j", "node", "far", "o"), "block-members")
    texts = fetch(met).select("group", "i", "j", "node", "far", "o", "text").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node")
    more = ws.save(texts.mapInArrow(blocks(percent, sets_of), "a long, b long"), "block-links")
    return links.union(more)


def similar_sets(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 85, part_bytes: int = 8 << 20, ws: Workspace | None = None) -> DataFrame:
    """``doc_id, n_shingles, node, component_id`` for every row of ``docs(doc_id, text)``.

    Words are runs of other than white space with A-Z lower-cased; a document
    of fewer than ``k`` words has its whole sequence as its one shingle.
    Documents link when 100 * intersection >= percent * union.
    ``component_id`` is the smallest doc_id reachable by links.  Null, empty
    and wordless texts have no shingles and no links.  A null doc_id has no
    node to be reached by and is its own (null) component.  Rows that repeat
    a doc_id stand for themselves.  Copies share a node; ties need no order.
    """
    ws = ws or Workspace(spark, "set-join")
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    profile = ws.save(docs.mapInArrow(_profile(k), f"doc_id {id_type}, node long, n long, chunk int, counts binary"), "profile")
    documents = profile.filter("chunk is null").select("doc_id", "node", "n")
    classes = ws.save(documents.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
    frequent = frequency_classes(profile)
    parts = part_count(spark, docs, part_bytes)
    listed = "tok long, node long, n long, part int, payload binary"
    found = ws.save(docs.filter("doc_id is not null").select("text").mapInArrow(_prefixes(k, percent, frequent, parts), listed), "prefixes")
    lists = found.filter("payload is not null").select("part", "payload").groupBy("part").applyInArrow(_lists(percent), "tok long, node long, n long, other long, times long")
    lists = ws.save(lists, "lists")
    pairs = lists.filter("tok is null").groupBy("node", "other").agg(F.sum("times").alias("times"), F.min("n").alias("n"))
    long = lists.filter("tok is not null").select("tok", "node", "n").union(found.filter("payload is null").select("tok", "node", "n"))
    # A pair may meet in long lists too, at most in as many as either set is in.
    # An entry of a hot key may count twice, which only lets more pairs through.
    count = ws.save(long.groupBy("node").agg(F.count(F.lit(1)).alias("c")), "long-lists")
    for side in ("node", "other"):
        pairs = pairs.join(count.select(F.col("node").alias(side), F.col("c").alias(f"{side}_c")), side, "left")
    more = F.least(*[F.coalesce(f"{side}_c", F.lit(0)) for side in ("node", "other")])
    pairs = pairs.filter(F.col("times") + more >= 1 + F.floor(F.col("n") / 20)).select(F.col("node").alias("hub"), F.col("other").alias("node"))
    in_lists = F.col("n") * (100 - percent) / 100 + 1 + F.floor(F.col("n") / 20)
    pairs = pairs.union(hub_pairs(ws, long, percent, in_lists, 1 + F.floor(F.col("n") * percent / 100 / 20))).distinct()

    def fetch(wanted):
        wanted = wanted.join(classes.select("node", F.col("rep").alias("doc_id")), "node")
        return having(docs, wanted.select("doc_id")).join(wanted, "doc_id")

    def sets_of(batch):
        for tokens in token_sets(batch, k):
            yield node_of(tokens), tokens

    links = group_links(ws, pairs, percent, fetch, sets_of)
    comps = components(ws, links)

    per_node = ws.save(classes.join(comps, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "per-node")
    smallest = ws.save(per_node.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")
    per_node = ws.save(per_node.join(smallest, "component").select("node", "component_id"), "named")
    ws.drop("prefixes", "lists", "long-lists", "classes", "per-node", "smallest", *GROUP_TABLES)
    out = documents.withColumn("on", F.when(F.col("doc_id").isNotNull(), F.col("node"))).join(per_node.withColumnRenamed("node", "on"), "on", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"))
