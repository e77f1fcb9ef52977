"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces. Pieces are
dealt into shards of bounded size by a hash of what they are, never of where
they lie, and each shard is packed on its own: longest piece first, into the open bin that it fits best; if none has room, a bin of
the least-cost length is opened. The shortest length that may be opened is
tried at every permitted value, the cheapest packing is kept, and at last
every bin shrinks to the shortest permitted length that holds its contents.

Defined results: a document of length 0 (null or empty text) has one piece of
length 0 in no bin; a null id is packed like any other; rows of equal id and
length are told apart by a running number `copy`, and each is packed; an empty
table gives an empty result. Extra columns are dropped, whatever their names;
`start` and `length` say which words of a document a piece holds. No piece is
lost, and none overlaps another.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scratch import materialise

LENGTHS = (256, 512, 1024, 2048, 4096)
#: Pieces packed together in one task.
SHARD = 100_000
#: Rows of one id and length that one task numbers.
CHUNK = 100_000


def cost(length: int) -> float:
    """Cost of one sequence: its tokens, attention that grows with the square, and a fixed overhead."""
    return length * (1 + length / 8192) + 64


def pack(sizes: np.ndarray, lengths=LENGTHS, cost=cost, shortest: int = 0) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each piece and the final length of each bin; no bin under `shortest` is opened. sizes are 1 to the longest length."""
    lengths = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: dict[int, list[int]] = {}  # open bins by room
    rooms = 0  # bit r: some bin has room r
    opened: list[int] = []
    filled: list[int] = []
    left = int(sizes.sum())
    for i in order.tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1  # the least room that is enough
            stack = free[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            # least cost for each token that it can still get
            room = min((x for x in lengths if x >= max(size, shortest)), key=lambda x: (cost(x) / min(x, left), x))
            b = len(opened)
            opened.append(room)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        left -= size
        if room > size:
            free.setdefault(room - size, []).append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, [lengths[bisect.bisect_left(lengths, x)] for x in filled]


def pack_jointly(sizes: np.ndarray, lengths=LENGTHS, cost=cost) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The cheapest packing over all choices of the shortest length that is opened."""
    return min((pack(sizes, lengths, cost, x) for x in lengths), key=lambda p: sum(map(cost, p[2])))


def _copies(docs: DataFrame, length: Column, doc_id: str) -> DataFrame:
    """(doc_id, n, copy): rows of equal id and length numbered from their count, so that no group of them is ordered in one task."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    counted = materialise(rows.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("times")))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {CHUNK}"))))
    if (counted.agg(F.max("times")).first()[0] or 0) > CHUNK:
        chunks = chunks.repartition("doc_id", "n", "chunk")
    last = F.least(F.col("times"), (F.col("chunk") + 1) * CHUNK) - 1
    return chunks.select("doc_id", "n", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("copy"))


def pack_documents(docs: DataFrame, length: Column, doc_id: str = "doc_id", lengths=LENGTHS, cost=cost, shard: int = SHARD) -> DataFrame:
    """(doc_id, copy, piece, start, length, bin_id, bin_length, bin_start): one row for each piece of each row of docs, the same however docs is partitioned."""
    longest = max(lengths)
    rows = _copies(docs, length, doc_id)
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = materialise(rows.select("doc_id", "n", "copy", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(F.col("n") - F.col("piece") * longest, F.lit(longest)).alias("length")))
    shards = max(1, math.ceil(rows.count() / shard))
    order = [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "n", "copy", "piece")]]

    def one(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        bins, offsets, ends = pack_jointly(part["length"].to_numpy(), lengths, cost)
        base = part["shard"][0].as_py() << 32
        part = part.select(["doc_id", "copy", "piece", "start", "length"])
        for name, values in (("bin_id", base + bins), ("bin_length", np.array(ends, np.int64)[bins]), ("bin_start", offsets)):
            part = part.append_column(name, pa.array(values))
        return part

    kind = rows.schema["doc_id"].dataType.simpleString()
    filled = rows.where("length > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "copy", "piece"), F.lit(shards)))
    packed = filled.groupBy("shard").applyInArrow(one, f"doc_id {kind}, copy long, piece int, start long, length long, bin_id long, bin_length long, bin_start long")
    nothing = F.lit(None).cast("long")
    return packed.unionByName(rows.where("length = 0").select("doc_id", "copy", "piece", "start", "length", nothing.alias("bin_id"), nothing.alias("bin_length"), nothing.alias("bin_start")))
