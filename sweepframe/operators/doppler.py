"""Slow time: transmitter separation, range-Doppler maps, micro-Doppler."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions import kernels
from sweepframe.functions.signal import db20
from sweepframe.operators.cube import frame_mean
from sweepframe.operators.ranges import cells, mean_arrays, range_fft


def transmit_positions(masks: list[int] | None, unique: int) -> list[int]:
    """The places of the pattern that belong to one transmitter: the lowest mask that is a single one of the first three, else the first active mask; every second place without masks."""
    if not masks or len(masks) != unique:
        return list(range(0, unique or 2, 2))
    active = [m for m in masks if m]
    if not active:
        return list(range(len(masks)))
    chosen = min([m for m in active if m in (1, 2, 4)], default=active[0])
    return [i for i, m in enumerate(masks) if m == chosen]


def separate(cube: DataFrame, positions: list[int], stride: int, chirps: int) -> DataFrame:
    """(capture_id, frame, rx, loop, re, im): the chirps of one transmitter by loop, the mean of several places of a loop. Where the stride doesn't divide the chirps, every second chirp."""
    keys = ["capture_id", "frame", "rx", "loop"]
    if chirps % stride:
        return cube.where("chirp % 2 = 0").select("capture_id", "frame", "rx", F.expr("cast(chirp div 2 as int)").alias("loop"), "re", "im")
    picked = cube.where((F.col("chirp") % stride).isin(positions)).withColumn("loop", F.expr(f"cast(chirp div {stride} as int)"))
    if len(positions) == 1:
        return picked.select(*keys, "re", "im")
    return frame_mean(picked, keys)


def frame_stack(rows: pd.DataFrame) -> np.ndarray:
    """Rows of one frame -> (rx, bins, loops)."""
    rows = rows.sort_values(["rx", "loop"])
    x = np.stack(rows["re"].to_numpy()) + 1j * np.stack(rows["im"].to_numpy())
    return np.swapaxes(x.reshape(rows["rx"].nunique(), -1, x.shape[1]), 1, 2)


def combine(x: np.ndarray, mode: str) -> np.ndarray:
    """(rx, bins, doppler) -> (bins, doppler): MRC, SUM or RXk, as magnitudes."""
    mode = mode.upper()
    if mode == "SUM":
        return np.abs(x.sum(axis=0))
    if mode.startswith("RX"):
        k = int(mode[2:]) if mode[2:].lstrip("-").isdigit() else 0
        return np.abs(x[max(0, min(len(x) - 1, k))])
    return np.sqrt((np.abs(x) ** 2).sum(axis=0))


def range_doppler(cube: DataFrame, positions: list[int], stride: int, chirps: int, n_fft_range: int = 256, n_fft_doppler: int | None = None, mode: str = "MRC", window: str | None = "hann", full: bool = True, real: bool = False, then=None) -> DataFrame:
    """(capture_id, frame, doppler_idx, mag array over range): one map for each frame of each capture.

    Chirps are chosen before anything is transformed; range spectra are
    computed where the rows are; one shuffle by (capture, frame) brings a frame
    together. then: (key, map) -> DataFrame, a further step inside the same group.
    """
    spectra = range_fft(separate(cube, positions, stride, chirps), n_fft_range, full=full, real=real)

    def frame(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = frame_stack(rows)
        found = combine(kernels.doppler(x, n_fft_doppler or x.shape[-1], window), mode).T
        if then:
            return then(key, found)
        return pd.DataFrame({"capture_id": key[0], "frame": key[1], "doppler_idx": np.arange(len(found), dtype=np.int32), "mag": list(found)})

    schema = then.schema if then else "capture_id string, frame int, doppler_idx int, mag array<double>"
    return spectra.groupBy("capture_id", "frame").applyInPandas(frame, schema)


def velocity(index: Column, n: int, step: float) -> Column:
    """m/s of a shifted Doppler bin."""
    return (index - n // 2) * F.lit(step)


def micro_doppler(rd: DataFrame, first: int = 5, last: int = 100) -> DataFrame:
    """(capture_id, frame, doppler_idx, db): the sum over range bins first to last, in either order, clamped to the map; a map that ends before them has no row. Each row of a map is summed where it is."""
    lo, hi = max(0, min(first, last)), max(first, last)
    part = F.slice("mag", lo + 1, hi - lo + 1)
    return rd.where(F.size("mag") > lo).select("capture_id", "frame", "doppler_idx", db20(F.aggregate(part, F.lit(0.0), lambda s, v: s + v), 1e-12).alias("db"))


def mean_profile(rd: DataFrame) -> DataFrame:
    """(capture_id, frame, range_idx, mag): the mean over Doppler; rows of a map are added up before they are shuffled."""
    return mean_arrays(rd, ["capture_id", "frame"])


class MeanProfile:
    """The mean over Doppler as a further step on each range-Doppler map: one array for each frame, without another shuffle."""

    schema = "capture_id string, frame int, mag array<double>"

    def __call__(self, key, found: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"capture_id": key[0], "frame": key[1], "mag": [found.mean(axis=0)]})


def at_bin(rd: DataFrame, frame: int, range_idx: int) -> DataFrame:
    """The Doppler spectrum of one frame at one range bin, in dB."""
    return rd.where(F.col("frame") == frame).select("capture_id", "doppler_idx", db20(F.get("mag", F.lit(range_idx))).alias("db"))


def zoom(rd: DataFrame, n: int, step: float, vmin: float = -5.0, vmax: float = 5.0) -> DataFrame:
    """Cells in dB with their velocity, between vmin and vmax if that is a range."""
    rows = cells(rd).select("capture_id", "frame", velocity(F.col("doppler_idx"), n, step).alias("velocity_ms"), "doppler_idx", "range_idx", db20(F.col("mag")).alias("db"))
    return rows.where(F.col("velocity_ms").between(vmin, vmax)) if vmin < vmax else rows
