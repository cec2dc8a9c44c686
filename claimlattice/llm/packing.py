"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest length are cut into full pieces and a rest.
Pieces are dealt at random into shards of bounded size; each shard is packed
on its own by best-fit decreasing: a piece goes into the open bin that it
leaves fullest, else opens the bin size that costs least for each token that
it would hold if the pieces still to come filled it as well as they can; at the
end every bin shrinks to the shortest permitted length that holds its
contents.  A sequence of n tokens costs ``n + overhead + n * n / attention``, so short ones
pay for their overhead and long ones for their attention.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .mixing import WORD

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of one sequence beyond its tokens, in tokens: a constant, and n * n / ATTENTION.
OVERHEAD, ATTENTION = 64, 1 << 16


def cost(n: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return n + overhead + n * n / attention


def best_fit(sizes: list[int], lengths, overhead: int, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each size (in the order given); permitted length and fill of each bin."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bin_of, offset = [0] * len(sizes), [0] * len(sizes)
    room, fill = [], []
    open_bins: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    mask = 0  # bit r: some bin has room r
    # Bit t of ahead[i]: some of the pieces from the i-th in order on have t tokens in all.
    ahead = [1] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        ahead[i] = (ahead[i + 1] | ahead[i + 1] << sizes[order[i]]) & ((2 << lengths[-1]) - 1)

    for at, i in enumerate(order):
        s = sizes[i]
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                mask &= ~(1 << r)
        else:
            best = {n: s + (ahead[at + 1] & ((2 << n - s) - 1)).bit_length() - 1 for n in lengths if n >= s}
            size = min(best, key=lambda n: (cost(n, overhead, attention) / best[n], n))
            b, r = len(room), size
            room.append(size), fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += s
        room[b] = r - s
        open_bins[r - s].append(b)
        mask |= 1 << (r - s)
    return bin_of, offset, [next(n for n in lengths if n >= f) for f in fill], fill


def pack(spark: SparkSession, docs: DataFrame, lengths=LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION, shard_items: int = 2500, ws: Workspace | None = None) -> DataFrame:
    """``doc_id, piece, begin, n_tokens, bin_id, bin_length, bin_fill, offset`` for every piece.

    Tokens are words (runs of other than white space).  ``begin`` is the
    piece's first token in its document, ``offset`` its place in the bin.
    Null, empty and wordless texts give one row of 0 tokens with null bin
    columns; an empty table gives no row, and columns other than doc_id and text
    are left out.  Very long texts are cut into pieces.  Repeated rows are packed
    as often as they stand; ties in size keep the order of the saved table.  A shard has about ``shard_items``
    pieces whatever the doc_ids or sources are.
    """
    ws = ws or Workspace(spark, "packing")
    longest = max(lengths)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", size.alias("size")).withColumn("row", F.monotonically_increasing_id())
    sized = ws.save(sized, "sized")  # row numbers hold from here on
    pieces = sized.select(
        "doc_id", "row", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / longest) - 1, F.lit(0)).cast("int"))).alias("piece")
    )
    begin = F.col("piece").cast("long") * longest
    pieces = pieces.select("doc_id", "row", "piece", begin.alias("begin"), F.least(F.col("size") - begin, F.lit(longest)).alias("n_tokens"))
    shards = max(1, -(-pieces.count() // shard_items))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], ignore_index=True)
        bins, offsets, long, fill = best_fit(pdf.n_tokens.tolist(), lengths, overhead, attention)
        return pd.DataFrame(
            {
                "doc_id": pdf.doc_id, "piece": pdf.piece, "begin": pdf.begin, "n_tokens": pdf.n_tokens,
                "bin_id": [f"{s}-{b}" for s, b in zip(pdf.shard, bins)],
                "bin_length": [long[b] for b in bins], "bin_fill": [fill[b] for b in bins], "offset": offsets,
            }
        )

    id_type = docs.schema["doc_id"].dataType
    schema = "doc_id string, piece int, begin long, n_tokens long, bin_id string, bin_length long, bin_fill long, offset long"
    # As strings, ids survive pandas whatever their type and nulls.
    bins = pieces.filter("n_tokens > 0").withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("shard").applyInPandas(packed, schema)
    bins = bins.withColumn("doc_id", F.col("doc_id").cast(id_type))
    none = pieces.filter("n_tokens = 0").select(
        "doc_id", "piece", "begin", "n_tokens", F.lit(None).cast("string").alias("bin_id"), *[F.lit(None).cast("long").alias(c) for c in ("bin_length", "bin_fill", "offset")]
    )
    return bins.unionByName(none)
