"""Hard negatives of labelled integer vectors, by scores in a secondary sort.

Anchors and rows are dealt to blocks, and every block of rows meets every block
of anchors in one task. From a task go only the pairs that can be in the result:
first, for each anchor, the best positives of its block; then, once the positives
of all blocks are known, the best negatives within the window of each positive.
A pair is packed into a key of bytes whose order is (anchor, score descending,
positives first, id). repartitionAndSortWithinPartitions brings the keys of an
anchor together in order, and an iterator goes through them once: a positive
opens its window, and negatives are handed out to the open windows until each is
full. Neither step holds the pairs of an anchor.

Defined results: rows take part if id, label and vector aren't null and no
component is null or not finite. Of rows that share an id, the one with the least
label counts, then the one with the least vector; so repeated rows count once.
Shorter vectors are filled up with zeros. Scores are exact; beyond 64 bits they
stay at the end of the range. Equal scores go by id, the smaller first. An empty
table gives an empty result. Columns other than those named are dropped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scratch import materialise

#: Rows, and anchors, of a block, and bytes of the scores that a task holds at a time.
ROW_BLOCK, ANCHOR_BLOCK, HELD = 8192, 16384, 16 << 20
_TOP = (1 << 63) - 1
_KEY = ">QQBQ"
_BITS = np.uint64(1 << 63)


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def one_each(rows: DataFrame) -> DataFrame:
    """(id, label, v): one row for each id."""
    sound = rows.where("id is not null and label is not null and v is not null")
    return sound.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _width(table: pa.Table) -> int:
    return int(np.diff(table["v"].combine_chunks().offsets.to_numpy()).max(initial=0))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact: doubles where they hold every sum, else longs, else Python's numbers."""
    most = max(map(abs, map(int, (a.max(initial=0), a.min(initial=0))))) * max(map(abs, map(int, (b.max(initial=0), b.min(initial=0))))) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -_TOP, _TOP).astype(np.int64)


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest allowed scores of each row, smaller columns first among equals."""
    n = scores.shape[1]
    if not n or not allowed.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if max(-int(scores.min()), int(scores.max())) < (1 << 62) // n:
        keys = np.where(allowed, scores * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)  # no two are equal
        k = min(k, n)
        at = np.argpartition(keys, n - k, axis=1)[:, n - k :]
        rows = np.repeat(np.arange(len(scores)), k)
        there = allowed[rows, at.ravel()]
        return rows[there], at.ravel()[there]
    found = [(r, c) for r in range(len(scores)) for c in sorted(np.flatnonzero(allowed[r]).tolist(), key=lambda c: (-int(scores[r, c]), c))[:k]]
    return np.array([r for r, _ in found], np.int64), np.array([c for _, c in found], np.int64)


def _packed(anchors: np.ndarray, scores: np.ndarray, kind: int, ids: np.ndarray) -> pa.Table:
    """Keys of pairs, in whose order of bytes the pairs are sorted."""
    out = np.empty(len(ids), [("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
    out["anchor"], out["id"] = anchors.view(np.uint64) ^ _BITS, ids.view(np.uint64) ^ _BITS
    out["score"], out["kind"] = np.uint64(_TOP) - scores.view(np.uint64), kind
    return pa.table({"key": pa.array(map(bytes, out.view("V25").tolist()), pa.binary())}) if len(ids) else _NOTHING


_NOTHING = pa.table({"key": pa.array([], pa.binary())})


def _unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, id_ = struct.unpack(_KEY, key)
    return anchor - (1 << 63), _TOP - score, kind, id_ - (1 << 63)


def _strips(rows: pa.Table, anchors: pa.Table):
    """Scores of the rows, by id, with a few anchors at a time: (places of the anchors, ids of the rows, scores, equal labels, same row)."""
    rows = rows.sort_by("id")
    width = max(_width(rows), _width(anchors))
    ids, labels, r, a = rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"], width), _matrix(anchors["v"], width)
    own, kinds = anchors["id"].to_numpy(), anchors["label"].to_numpy()
    step = max(1, HELD // (8 * len(ids)))
    for at in range(0, len(own), step):
        part = slice(at, at + step)
        yield np.arange(at, min(at + step, len(own))), ids, _product(a[part], r), kinds[part, None] == labels, own[part, None] == ids


def _meet(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, step) -> DataFrame:
    """step(rows, anchors) for each pair of blocks; (key)."""
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))).withColumn("j", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int"))
    anchors = anchors.withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(anchor_blocks)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables(step(left, right)) if left.num_rows and right.num_rows else _NOTHING

    return rows.groupBy("i", "j").cogroup(anchors.groupBy("i", "j")).applyInArrow(cell, "key binary")


def _streamed(keys: DataFrame, follow, schema: str) -> DataFrame:
    """follow(iterator of sorted keys) in each partition; an anchor's keys are in one, in order."""
    spark = keys.sparkSession
    pairs = keys.rdd.map(lambda row: (bytes(row[0]), None))
    ordered = pairs.repartitionAndSortWithinPartitions(int(spark.conf.get("spark.sql.shuffle.partitions")), lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(ordered.mapPartitions(lambda part: follow(_unpacked(k) for k, _ in part)), schema)


def first_of_each(pairs: Iterator[tuple], k: int) -> Iterator[tuple]:
    """(anchor, id, score) of the first k pairs of each anchor."""
    now, n = None, 0
    for anchor, score, _, id_ in pairs:
        now, n = (anchor, 1) if anchor != now else (now, n + 1)
        if n <= k:
            yield anchor, id_, score


def windows(pairs: Iterator[tuple], k: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score): the first k negatives of each positive's window, low to high percent of its score."""
    now, opened = None, []
    for anchor, score, kind, id_ in pairs:
        if anchor != now:
            now, opened = anchor, []
        if kind == 0:
            opened.append([id_, score, 0])
            continue
        for window in opened:
            positive, top, _ = window
            if low * top <= 100 * score <= high * top:
                window[2] += 1
                yield anchor, positive, window[2], id_, top, score
        opened = [w for w in opened if w[2] < k and low * w[1] <= 100 * score]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(id, label, v array of longs) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    The positives of an anchor are its best other rows of the same label; the
    negatives of a positive the best rows of other labels whose score is low to
    high percent of the positive's.
    """
    rows = materialise(one_each(vectors.select("id", "label", "v")))
    anchors = rows.where(is_anchor)
    row_blocks, anchor_blocks = max(1, -(-rows.count() // ROW_BLOCK)), max(1, -(-anchors.count() // ANCHOR_BLOCK))

    def best_positives(left: pa.Table, right: pa.Table) -> list[pa.Table]:
        own, out = right["id"].to_numpy(), []
        for places, ids, scores, same, self_ in _strips(left, right):
            r, c = _best(scores, same & ~self_, positives)
            out.append(_packed(own[places[r]], scores[r, c], 0, ids[c]))
        return out

    found = _streamed(_meet(rows, anchors, row_blocks, anchor_blocks, best_positives), lambda pairs: first_of_each(pairs, positives), "id long, positive long, score long")
    known = found.groupBy("id").agg(F.collect_list(F.struct("score", "positive")).alias("best"))  # at most `positives` of them
    anchors = materialise(anchors.join(known, "id"))

    def best_negatives(left: pa.Table, right: pa.Table) -> list[pa.Table]:
        own, out = right["id"].to_numpy(), []
        tops = [[p["score"] for p in best] for best in right["best"].to_pylist()]
        for places, ids, scores, same, _ in _strips(left, right):
            for n in range(positives):
                top = [tops[p][n] if n < len(tops[p]) else None for p in places]
                bounds = np.array([(-(-low * t // 100), high * t // 100) if t is not None and t >= 0 else (1, 0) for t in top], np.int64)
                within = ~same & (scores >= bounds[:, :1]) & (scores <= bounds[:, 1:])
                r, c = _best(scores, within, negatives)
                out.append(_packed(own[places[r]], scores[r, c], 1, ids[c]))
        return out

    def opening(batches):
        for batch in batches:
            rows = [(a, p["score"], p["positive"]) for a, best in zip(batch["id"].to_pylist(), batch["best"].to_pylist()) for p in best]
            a, s, p = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
            yield from _packed(a, s, 0, p).to_batches()

    # a negative can be among the best of several positives, or of none but a block's
    every = _meet(rows, anchors, row_blocks, anchor_blocks, best_negatives).distinct().unionAll(anchors.select("id", "best").mapInArrow(opening, "key binary"))
    return _streamed(every, lambda pairs: windows(pairs, negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
