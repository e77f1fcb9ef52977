"""From raw words to the sample cube: by index arithmetic on rows of words, or, at scale, on rows that hold a frame's words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions import kernels


def demux(words: DataFrame, lanes: int, real: bool = False, swap: bool = False, lane_order: list[int] | None = None) -> DataFrame:
    """(capture_id, word_idx, v) -> (capture_id, s, i, q): scalar samples in file order.

    A group of complex samples has 2 x lanes words: first the I words of all
    lanes, then the Q words; a group of real samples has one word of each lane.
    lane_order takes lane k from place lane_order[k]; swap exchanges I and Q.
    Words of a group that isn't whole are dropped.
    """
    if lanes not in (1, 2, 4):
        raise ValueError("1, 2 or 4 lanes can be decoded")
    size = lanes if real else 2 * lanes
    group, place = F.expr(f"word_idx div {size}"), F.col("word_idx") % size
    lane = place % lanes
    if lane_order and len(lane_order) == lanes:
        back = [lane_order.index(k) for k in range(lanes)]
        lane = F.element_at(F.array(*map(F.lit, back)), (lane + 1).cast("int")).cast("long")
    s = group * lanes + lane
    if real:
        full = words.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
        rows = words.join(full, "capture_id").where(group < F.expr(f"n div {size}"))
        return rows.select("capture_id", s.alias("s"), F.col("v").cast("double").alias("i"), F.lit(None).cast("double").alias("q"))
    pick = lambda first: F.max(F.when((place < lanes) == first, F.col("v"))).cast("double")
    # both words of a sample are in one group of words, so an incomplete one is known by a missing half
    both = words.groupBy("capture_id", s.alias("s"), group.alias("g")).agg(pick(True).alias("i"), pick(False).alias("q"))
    whole = words.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
    both = both.join(whole, "capture_id").where(F.col("g") < F.expr(f"n div {size}"))
    return both.select("capture_id", "s", F.col("q" if swap else "i").alias("i"), F.col("i" if swap else "q").alias("q"))


def address(samples: DataFrame, n_samples: int, n_rx: int, chirps: int, interleaved: bool, frames: int | None = None) -> DataFrame:
    """Scalar samples -> (capture_id, frame, chirp, rx, n, i, q). Frames that aren't whole are dropped, and those from `frames` on."""
    base = n_samples * n_rx
    rows = samples.withColumn("g", F.expr(f"s div {base}")).withColumn("o", F.col("s") % base)
    rx, n = (F.col("o") % n_rx, F.expr(f"o div {n_rx}")) if interleaved else (F.expr(f"o div {n_samples}"), F.col("o") % n_samples)
    whole = rows.groupBy("capture_id").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / (base * chirps))).alias("whole"))
    rows = rows.join(whole, "capture_id").withColumn("frame", F.expr(f"g div {chirps}"))
    keep = F.col("frame") < (F.col("whole") if frames is None else F.least(F.col("whole"), F.lit(frames)))
    return rows.where(keep).select("capture_id", F.col("frame").cast("int").alias("frame"), (F.col("g") % chirps).cast("int").alias("chirp"), rx.cast("int").alias("rx"), n.cast("int").alias("n"), "i", "q")


def full_scale(x: Column, bits: int) -> Column:
    """Samples as a share of full scale."""
    return x / max(1, 2 ** (bits - 1) - 1)


def gather(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """Addressed samples -> the cube: (capture_id, frame, chirp, rx, re, im), im null for real samples."""
    scaled = (lambda c: full_scale(F.col(c), bits)) if bits else F.col
    ordered = F.array_sort(F.collect_list(F.struct("n", scaled("i").alias("i"), scaled("q").alias("q"))))
    out = rows.groupBy("capture_id", "frame", "chirp", "rx").agg(ordered.alias("x"))
    return out.select("capture_id", "frame", "chirp", "rx", F.col("x.i").alias("re"), F.when(F.exists("x.q", F.isnotnull), F.col("x.q")).alias("im"))


def decode_frames(frames: DataFrame, lanes: int, n_samples: int, n_rx: int, chirps: int, interleaved: bool, real: bool = False, swap: bool = False, lane_order: list[int] | None = None, bits: int | None = None) -> DataFrame:
    """(capture_id, frame, words array) -> the cube, without a shuffle: what the capture reader gives, decoded where it was read.

    The same rules as demux, address and gather, as one reshape for each batch of frames.
    """
    if lanes not in (1, 2, 4):
        raise ValueError("1, 2 or 4 lanes can be decoded")
    halves = 1 if real else 2
    size = chirps * n_rx * n_samples * halves
    if size % (lanes * halves):
        raise ValueError("a frame doesn't hold whole groups of lanes")
    scale = max(1, 2 ** (bits - 1) - 1) if bits else 1

    def decode(batches):
        for batch in batches:
            batch = batch[batch["words"].map(len) == size]
            if not len(batch):
                continue
            x = kernels.samples(np.stack(batch["words"].to_numpy()), lanes, n_samples, n_rx, chirps, interleaved, real, swap, lane_order, scale)
            places = np.indices(x.shape[:3]).reshape(3, -1)
            rows = x.reshape(-1, n_samples)
            yield pd.DataFrame({"capture_id": batch["capture_id"].to_numpy()[places[0]], "frame": batch["frame"].to_numpy()[places[0]].astype(np.int32), "chirp": places[1].astype(np.int32), "rx": places[2].astype(np.int32), "re": list(rows.real), "im": [None] * len(rows) if real else list(rows.imag)})

    return frames.select("capture_id", "frame", "words").mapInPandas(decode, "capture_id string, frame int, chirp int, rx int, re array<double>, im array<double>")


def select_positions(cube: DataFrame, positions: list[int], pattern: int, chirps: int) -> DataFrame:
    """The chirps at these places of the transmit pattern, in the given order, numbered anew; all chirps if the pattern doesn't divide them or a place isn't in it."""
    if not positions or pattern < 1 or chirps % pattern or not all(0 <= p < pattern for p in positions):
        return cube
    place = F.array_position(F.array(*map(F.lit, positions)), F.col("chirp") % pattern)
    new = F.expr(f"chirp div {pattern}") * len(positions) + place - 1
    return cube.where(place > 0).withColumn("chirp", new.cast("int"))


def frame_mean(cube: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, re, im): coherent mean of the re and im arrays over the other keys, which lie within one frame.

    The arrays of a key meet as they are and are added up in place: one shuffle,
    no row for each sample.
    """
    whole = cube.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chirp", "re", "im"))).alias("x"))
    mean = lambda part: F.transform(F.get(F.col("x")[part], F.lit(0)), lambda _, n: F.aggregate("x", F.lit(0.0), lambda s, v: s + F.get(v[part], n)) / F.size("x")).alias(part)
    return whole.select(*keys, mean("re"), mean("im"))
