"""Prefix trie of conversations: which beginnings they share.

Method: each conversation gets a digest of each of its prefixes.  The smallest
conversation with a prefix owns it (one aggregation gives these minima).  Who
owns a prefix owns all longer ones of the same conversation, so the depths
that a conversation owns are a tail of its turns, and its first owned depth is
found by binary search: in each round all conversations that are still
searching join one prefix each against the minima.  An owned tail is a chain
of nodes; chains hang on each other and form the tree.  Totals of subtrees are
added bottom-up over chains, each round to ancestors twice as far away, and
then along each chain.

Rows are numbered and summed in ranges, so neither a conversation nor a prefix
with a third of all rows meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import in_ranges, range_of
from .common import Workspace
from .digests import joined_sha256

#: Numbers in one block of ids that are joined before they are digested: 2 ** BLOCK_BITS.
BLOCK_BITS = 12


def turns_of(conversations: DataFrame, ws: Workspace) -> DataFrame:
    """``conv_id, place`` (from 1) ``, h1, h2, bytes``: turns in order of turn (nulls first), role and text; by digest and length."""
    plain = conversations.filter("conv_id is not null").select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    dealt = plain.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange("conv_id", "turn", "role", "text", "_salt").sortWithinPartitions("conv_id", "turn", "role", "text")
    marks = ws.save(
        dealt.select(
            "conv_id", F.monotonically_increasing_id().alias("_at"), F.xxhash64(F.lit(1), "role", F.lit("/"), "text").alias("h1"), F.xxhash64(F.lit(2), "role", F.lit("/"), "text").alias("h2"),
            F.octet_length("text").cast("long").alias("bytes"),
        ),
        "marks",
    ).withColumn("_part", range_of())
    parts = marks.groupBy("conv_id", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return marks.join(parts, ["conv_id", "_part"]).select("conv_id", (F.col("_at") + F.col("_shift")).alias("place"), "_part", "h1", "h2", "bytes")


def prefixes(turns: DataFrame, ws: Workspace) -> DataFrame:
    """``conv_id, depth, x1, x2, bytes`` of all prefixes but the empty one.

    ``turns(conv_id, place, _part, h1, h2, bytes)``, where a higher ``_part``
    of a conversation holds its later places.  A prefix's digest is the
    exclusive or of 128 bits for each (place, turn) in it.
    """
    mixed = turns.select("conv_id", "_part", "place", "bytes", *[F.xxhash64(F.lit(i), "place", "h1", "h2").alias(f"g{i}") for i in (1, 2)])
    own = Window.partitionBy("conv_id", "_part").orderBy("place")
    local = mixed.select("conv_id", "_part", "place", "bytes", *[F.expr(f"bit_xor(g{i})").over(own).alias(f"x{i}") for i in (1, 2)])
    local = ws.save(local, "local")
    ends = local.groupBy("conv_id", "_part").agg(*[F.max_by(f"x{i}", "place").alias(f"e{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("conv_id", "_part", *[F.coalesce(F.expr(f"bit_xor(e{i})").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    whole = local.join(carry, ["conv_id", "_part"])
    return whole.select("conv_id", F.col("place").alias("depth"), *[F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"x{i}") for i in (1, 2)], "bytes")


@dataclass
class Trie:
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes.  ``ends``: conv_id, depth, member: the node that each conversation ends at."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(spark: SparkSession, turns: DataFrame, everyone: DataFrame, ws: Workspace | None = None) -> Trie:
    """The trie of ``turns(conv_id, place, _part, h1, h2, bytes)``; ``everyone(conv_id)`` are all conversations, also those without turns.

    A node is a distinct sequence of first turns, named by the smallest
    conversation that begins with it and its depth; the root has depth 0.
    ``saved_bytes`` of a node sums over its subtree the bytes of each node's
    last text times the members but one.  Conversations of equal turns are
    members of the same nodes; an empty table has no node.  Equal sequences
    are told by digests of 128 bits.
    """
    ws = ws or Workspace(spark, "prefix-trie")
    some = ws.save(prefixes(turns, ws), "prefixes")
    sizes = everyone.join(some.groupBy("conv_id").agg(F.max("depth").alias("size")), "conv_id", "left").select("conv_id", F.coalesce("size", F.lit(0)).alias("size"))
    sizes = ws.save(sizes, "sizes")
    zero = F.lit(0).cast("long")
    root = sizes.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").withColumns({"depth": zero, "bytes": zero})
    minima = some.groupBy("depth", "x1", "x2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"))
    minima = ws.save(minima, "minima")

    # Binary search for the first owned depth, in (low, high]: depth low is owned by ``under``, depth high by the conversation (size + 1: by none).
    first = root.first()
    if first is None:
        empty = spark.range(0)
        nodes = empty.select(F.col("id").alias("conv_id"), *[zero.alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes")])
        return Trie(nodes, empty.select(F.col("id").alias("conv_id"), zero.alias("depth"), zero.alias("member")))
    lead = F.lit(first["owner"])
    search = sizes.select("conv_id", "size", F.when(F.col("conv_id") == lead, -1).otherwise(0).cast("long").alias("low"), F.when(F.col("conv_id") == lead, 0).otherwise(F.col("size") + 1).alias("high"), lead.alias("under"))
    settled, active, rounds = search.filter("high - low <= 1"), search.filter("high - low > 1"), 0
    found = [ws.save(settled, "found-0")]
    active = ws.save(active, "search-0")
    while not active.isEmpty():
        rounds += 1
        asked = active.withColumn("depth", F.expr("(low + high) div 2"))
        met = asked.join(some.select("conv_id", "depth", "x1", "x2"), ["conv_id", "depth"]).join(minima.select("depth", "x1", "x2", "owner"), ["depth", "x1", "x2"])
        own = F.col("owner") == F.col("conv_id")
        step = met.select(
            "conv_id", "size", F.when(own, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(own, F.col("depth")).otherwise(F.col("high")).alias("high"),
            F.when(own, F.col("under")).otherwise(F.col("owner")).alias("under"),
        )
        step = ws.save(step, f"step-{rounds}")
        found.append(step.filter("high - low <= 1"))
        active = step.filter("high - low > 1")
    chains = found[0]
    for more in found[1:]:
        chains = chains.unionByName(more)
    # top: the first owned depth; the chain hangs on node (under, top - 1).
    chains = ws.save(chains.select("conv_id", "size", F.col("high").alias("top"), F.when(F.col("high") > 0, F.col("under")).alias("under")), "chains")
    ends = chains.select(F.when(F.col("top") <= F.col("size"), F.col("conv_id")).otherwise(F.col("under")).alias("conv_id"), F.col("size").alias("depth"), F.col("conv_id").alias("member"))
    owned = chains.filter("top <= size")

    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "bytes").unionByName(root.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "bytes"))
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
    hung = owned.filter("top > 0").groupBy(F.col("under").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"))

    # What each chain adds by itself, then all that hangs on it: bottom-up, to ancestors 1, 2, 4, ... chains away.
    alone = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"))
    tails = owned.join(hung.withColumnRenamed("depth", "size"), ["conv_id", "size"], "left")
    tails = tails.select("conv_id", F.col("under").alias("up"), "top", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    sums = ws.save(tails.join(alone, "conv_id").select("conv_id", "up", "leaves", "saved"), "sums-0")
    rounds = 0
    while not sums.filter("up is not null").isEmpty():
        rounds += 1
        passed = sums.filter("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = sums.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        new = sums.join(passed, "conv_id", "left").join(above, "up", "left")
        new = new.select(
            "conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
        )
        sums = ws.save(new, f"sums-{rounds}")

    # Along each chain: what lies at a node and what hangs on it, summed from the chain's end.
    totals = sums.drop("up").join(owned.select("conv_id", "under", "top"), "conv_id")
    at = totals.filter("top > 0").groupBy(F.col("under").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved")
    )
    last = owned.select("conv_id", F.col("size").alias("depth"), F.lit(1).cast("long").alias("is_last"))
    here = nodes.join(at, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left").na.fill(0, ["hung", "hung_leaves", "hung_saved", "is_last"])
    here = here.select(
        "conv_id", (-F.col("depth")).alias("back"), "n_convs", (F.col("hung") + 1 - F.col("is_last")).alias("n_children"),
        (F.col("hung_leaves") + F.when((F.col("is_last") == 1) & (F.col("hung") == 0), 1).otherwise(0)).alias("leaves"), (F.col("own") + F.col("hung_saved")).alias("saved"),
    )
    dealt = in_ranges(here, ["conv_id", "back"], ws.save, "dealt").withColumn("_part", range_of())
    local = Window.partitionBy("conv_id", "_part").orderBy("back")
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("conv_id", "_part").agg(F.sum("leaves").alias("pl"), F.sum("saved").alias("ps"))
    parts = parts.select("conv_id", "_part", *[F.coalesce(F.sum(c).over(earlier), zero).alias(c) for c in ("pl", "ps")])
    summed = dealt.withColumns({"sl": F.sum("leaves").over(local), "ss": F.sum("saved").over(local)}).join(parts, ["conv_id", "_part"]).join(owned.select("conv_id", "top", "under"), "conv_id")
    depth = -F.col("back")
    parent = F.when(depth > F.col("top"), F.col("conv_id")).otherwise(F.col("under"))
    return Trie(
        summed.select("conv_id", depth.alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", (F.col("sl") + F.col("pl")).alias("n_leaves"), (F.col("ss") + F.col("ps")).alias("saved_bytes")), ends
    )


def joined_ends(ends: DataFrame, ws: Workspace) -> DataFrame:
    """``conv_id, depth, sha256``: of the decimal ids, ascending and joined by commas, of the conversations that end at each node.

    Ids are joined in blocks first, wherever they lie; a node at which a third of all conversations end is
    digested from few rows.
    """
    dealt = in_ranges(ends, ["conv_id", "depth", "member"], ws.save, "ends")
    block = F.shiftright("_at", BLOCK_BITS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda c: c.cast("string")), ",")
    blocks = dealt.groupBy("conv_id", "depth", block.alias("block")).agg(ids.alias("ids"))
    return joined_sha256(blocks, ["conv_id", "depth"], ["block"], "ids", ",")
