"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length, and the pieces dealt to shards of
bounded size by a hash. A shard packs its pieces, longest first: a piece goes into the open
sequence that it leaves least room in; if it fits in none, a new sequence opens, of the length
whose cost for each token it can expect to hold is least, given what is still to be packed. At
the end every sequence shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.mixing import word_count
from textlab.session import materialize, ship_package

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 128.0           # cost of a sequence besides its tokens
ATTENTION = 16384.0        # length at which attention costs as much as everything else
SHARD_PIECES = 50_000


def cost(length: float, overhead: float = OVERHEAD) -> float:
    """Cost of a sequence of a permitted length, in tokens: long ones pay for attention, short ones for overhead."""
    return length * (1.0 + length / ATTENTION) + overhead


def pack(sizes: np.ndarray, lengths=LENGTHS, overhead: float = OVERHEAD):
    """(bin, offset) of every piece, in the given order, and (length, used) of every bin. The pieces
    are packed longest first, equal ones in the given order; none may be longer than the largest length."""
    lengths = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    ranked = sizes[order]
    behind = np.concatenate([np.cumsum(ranked[::-1])[::-1], [0]])      # tokens of the pieces from a place on
    descending = -ranked
    bins, offsets = np.empty(sizes.size, np.int64), np.empty(sizes.size, np.int64)
    room: list[tuple[int, int]] = []                                   # (free, bin) of the open bins
    cap, used = [], []
    free_total = 0
    for place, (i, s) in enumerate(zip(order.tolist(), ranked.tolist())):
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, b = room.pop(at)
            free_total -= free
        else:
            best = None
            for c in lengths:
                if c < s:
                    continue
                rest = c - s
                start = max(place + 1, int(np.searchsorted(descending, -rest)))     # pieces that fit beside it
                hold = s + min(rest, max(0, int(behind[start]) - free_total))
                unit = cost(_downsized(hold, lengths), overhead) / hold
                if best is None or unit < best[0]:
                    best = (unit, c)
            b = len(cap)
            cap.append(best[1])
            used.append(0)
            free = best[1]
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        if free - s > 0:
            insort(room, (free - s, b))
            free_total += free - s
    final = [_downsized(u, lengths) for u in used]
    return bins, offsets, np.array(final, np.int64), np.array(used, np.int64)


def _downsized(used: int, lengths) -> int:
    return lengths[bisect_left(lengths, used)]


def _pack_shard(lengths, overhead):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("key", "ascending"), ("piece", "ascending")])
        bins, offsets, cap, used = pack(t.column("length").to_numpy(), lengths, overhead)
        names = np.char.add(f"{t.column('shard')[0].as_py()}-", bins.astype(str)) if bins.size else np.empty(0, str)
        return pa.table({"rid": t.column("rid"), "piece": t.column("piece"), "bin_id": pa.array(names.tolist(), pa.string()),
                         "bin_length": cap[bins], "bin_used": used[bins], "bin_offset": offsets})
    return run


def best_fit(docs: DataFrame, lengths=LENGTHS, overhead: float = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequence and place of every piece of every document.

    Returns one row per piece: ``doc_id``, ``rid`` (number of the input row),
    ``size`` (words of the document), ``piece`` (from 0), ``start`` (first word of the piece),
    ``length`` (its words), ``bin_id``, ``bin_length`` (one of ``lengths``), ``bin_used``, ``bin_offset``. The pieces of a document
    follow each other and cover it; all but the last are as long as the largest length. A document without words (or with a null text) has
    one piece of length 0 in no sequence (null bin). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    top = max(lengths)
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.monotonically_increasing_id().alias("rid")), "sizes")
    pieces = rows.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(top).cast("long"))).alias("piece", "start")) \
        .withColumn("length", F.least(F.lit(top).cast("long"), F.col("size") - F.col("start")))
    total = rows.agg(F.sum(F.ceil(F.col("size") / top))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_PIECES))
    # rows with the same id and text are spread by their row number
    shard = F.pmod(F.xxhash64("key", "rid", "piece"), F.lit(shards)).alias("shard")
    placed = pieces.filter("length > 0").select("rid", "key", "piece", "length", shard).groupBy("shard").applyInArrow(
        _pack_shard(tuple(lengths), overhead), "rid long, piece int, bin_id string, bin_length long, bin_used long, bin_offset long")
    return pieces.join(placed, ["rid", "piece"], "left").select(
        "doc_id", "rid", "size", "piece", "start", "length", "bin_id", "bin_length", "bin_used", "bin_offset")
