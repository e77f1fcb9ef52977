"""Series that no task holds whole: transforms in two steps, filters over blocks of time, windows that slide.

A transform of n = R x C points is R transforms over the frames that share a
column c = frame mod C, turned, and then C-point transforms over the columns for
each k mod R. Groups are blocks of columns, then blocks of k; the mean is taken
off at the end, by the transform of the window alone, so nothing must be known
of a capture but its number of frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.functions.groups import in_groups
from sweepframe.functions.signal import next_pow2

#: Numbers of each component that a group of a two-step transform holds, where one column or row doesn't hold more.
BLOCK = 1 << 16
#: Samples of a block of a filter.
FILTER_BLOCK = 4096
#: Most complex numbers that sliding sums hold at a time.
HELD = 1 << 20


def fft_size(frames: int) -> int:
    """The next power of two, 32 at least."""
    return 1 << (max(32, frames) - 1).bit_length()


def fft_size_of(frames: Column) -> Column:
    return next_pow2(F.greatest(F.lit(32), frames))


def hann_transform(k: np.ndarray, frames: int, n: int) -> np.ndarray:
    """The transform of a symmetric Hann window of so many frames, filled up to n points, at the frequencies k."""
    if frames < 2:
        return np.ones(np.shape(k), complex)
    turn, step = 2 * np.pi * np.asarray(k) / n, 2 * np.pi / (frames - 1)

    def ones(angle):
        angle = (angle + np.pi) % (2 * np.pi) - np.pi
        half = np.sin(angle / 2)
        zero = np.abs(half) < 1e-14
        return np.exp(-0.5j * angle * (frames - 1)) * np.where(zero, frames, np.sin(frames * angle / 2) / np.where(zero, 1.0, half))

    return 0.5 * ones(turn) - 0.25 * (ones(turn - step) + ones(turn + step))


def _sides(n: int) -> tuple[int, int]:
    r = 1 << ((n.bit_length() - 1) // 2)
    return r, n // r


def positions(rows: DataFrame, keys: list[str], time: str, into: str, block: int = FILTER_BLOCK) -> DataFrame:
    """rows numbered from 0 in order of time within keys, by blocks of time: a table of their sizes carries the count on, so no task orders a whole series."""
    inside = Window.partitionBy(*keys, "__block").orderBy(time)
    line = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__block", F.floor(F.col(time) / block))
    before = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__size")).withColumn("__before", F.coalesce(F.sum("__size").over(line), F.lit(0))).drop("__size")
    return rows.join(before, [*keys, "__block"]).withColumn(into, F.col("__before") + F.row_number().over(inside) - 1).drop("__block", "__before")


def amplitudes(rows: DataFrame, reduce: Callable[[tuple, np.ndarray, np.ndarray, int, float], pd.DataFrame | tuple], schema: str, block: int = BLOCK) -> DataFrame:
    """reduce((capture_id, cell), k, amplitudes as k x components, points, fps) for parts of the half spectrum of each series: rows, or one row as a tuple.

    rows: capture_id, cell, frame (0 to frames - 1; a missing one counts as 0),
    frames, fps, and the components x of a frame as an array. The spectrum is
    that of x without its mean, times a Hann window, filled up to a power of two.
    """
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("capture_id", "cell")}
    names = [c.split()[0] for c in schema.split(", ")]
    log = F.length(F.bin(fft_size_of(F.col("frames")))) - 1
    side = F.expr("shiftleft(1L, cast(__log div 2 as int))")
    columns = F.expr("shiftleft(1L, cast(__log - __log div 2 as int))")
    dealt = rows.withColumn("__log", log).withColumn("cblock", F.floor((F.col("frame") % columns) / F.greatest(F.lit(1), F.floor(F.lit(block) / side))).cast("int")).drop("__log")

    def first_of(key: tuple, frames: int, fps: float, at: np.ndarray, x: np.ndarray) -> list[tuple]:
        n = fft_size(frames)
        r, c = _sides(n)
        per = max(1, block // r)
        first = key[2] * per
        window = 0.5 - 0.5 * np.cos(2 * np.pi * at / (frames - 1)) if frames > 1 else np.ones(len(at))
        cells = np.zeros((r, min(per, c - first), x.shape[1]))
        cells[at // c, at % c - first] = x * window[:, None]
        half = np.arange(r // 2 + 1)
        y = np.fft.fft(cells, axis=0)[half] * np.exp(-2j * np.pi * np.outer(half, first + np.arange(cells.shape[1])) / n)[:, :, None]
        out = max(1, block // c)
        return [(key[0], key[1], b, key[2], frames, fps, y[b * out : (b + 1) * out].tobytes(), x.sum(axis=0)) for b in range(-(-len(half) // out))]

    def first_step(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        keys = zip(*(rows[c].iloc[bounds[:-1]].tolist() for c in ("capture_id", "cell", "cblock")))
        frames, rates = (rows[c].to_numpy()[bounds[:-1]].tolist() for c in ("frames", "fps"))
        at, x = rows["frame"].to_numpy(), rows["x"].to_numpy()
        found = [row for key, n, fps, a, b in zip(keys, frames, rates, bounds, bounds[1:]) for row in first_of(key, n, fps, at[a:b], np.stack(x[a:b]))]
        return pd.DataFrame(found, columns=["capture_id", "cell", "kblock", "cblock", "frames", "fps", "body", "total"])

    turned = in_groups(dealt, ["capture_id", "cell", "cblock"], first_step, f"capture_id {kind['capture_id']}, cell {kind['cell']}, kblock int, cblock int, frames int, fps double, body binary, total array<double>")

    def second_of(key: tuple, frames: int, fps: float, cblocks: np.ndarray, bodies: np.ndarray, totals: np.ndarray) -> pd.DataFrame | tuple:
        width = len(totals[0])
        n = fft_size(frames)
        r, c = _sides(n)
        per, out = max(1, block // r), max(1, block // c)
        low = np.arange(key[2] * out, min((key[2] + 1) * out, r // 2 + 1))
        z = np.zeros((len(low), c, width), complex)
        for b, body in zip(cblocks, bodies):
            part = np.frombuffer(body, complex).reshape(len(low), -1, width)
            z[:, b * per : b * per + part.shape[1]] = part
        k = low[:, None] + r * np.arange(c)
        spectrum = np.fft.fft(z, axis=1) - hann_transform(k, frames, n)[:, :, None] * (np.stack(totals).sum(axis=0) / frames)
        # k and n - k are conjugates: both are here only for the first and the middle k mod R
        once = (k <= n // 2) | ((low != 0) & (low != r // 2))[:, None]
        return reduce((key[0], key[1]), np.where(k > n // 2, n - k, k)[once], np.abs(spectrum[once]), n, fps)

    def second_step(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        keys = zip(*(rows[c].iloc[bounds[:-1]].tolist() for c in ("capture_id", "cell", "kblock")))
        frames, rates = (rows[c].to_numpy()[bounds[:-1]].tolist() for c in ("frames", "fps"))
        cblocks, bodies, totals = (rows[c].to_numpy() for c in ("cblock", "body", "total"))
        found = [second_of(key, n, fps, cblocks[a:b], bodies[a:b], totals[a:b]) for key, n, fps, a, b in zip(keys, frames, rates, bounds, bounds[1:])]
        return pd.concat(found, ignore_index=True) if isinstance(found[0], pd.DataFrame) else pd.DataFrame(found, columns=names)

    return in_groups(turned, ["capture_id", "cell", "kblock"], second_step, schema)


def taps(low: float, high: float, fps: float, seconds: float) -> np.ndarray:
    """Coefficients of a symmetric band-pass filter of twice so many seconds: an ideal one under a Hamming window. Bands end at half the frame rate."""
    half = max(1, round(seconds * fps))
    j = np.arange(-half, half + 1)
    side = lambda f: 2 * f / fps * np.sinc(2 * f / fps * j)
    return (side(min(high, fps / 2)) - side(min(low, fps / 2))) * (0.54 + 0.46 * np.cos(np.pi * j / half))


def band_pass(series: DataFrame, low: float, high: float, fps: float | str, seconds: float = 8.0, keys: list[str] | None = None, time: str = "t", value: str = "value", block: int = FILTER_BLOCK) -> DataFrame:
    """(keys, time, value): the series filtered by taps(), without delay.

    Overlap-save over blocks of time: a block gets as many rows of its
    neighbours as the filter reaches, and is multiplied by the filter's spectrum.
    Before the first and after the last sample their values go on; a missing
    sample has the value of the one before it. Null samples are missing. fps: a
    number, or the name of a column.
    """
    keys = keys or ["capture_id"]
    rate = F.col(fps) if isinstance(fps, str) else F.lit(float(fps))
    reach = F.greatest(F.lit(1), F.bround(F.col("__fps") * seconds).cast("int"))
    rows = series.where(F.col(value).isNotNull()).select(*keys, F.col(time).cast("long").alias("__t"), F.col(value).cast("double").alias("__v"), rate.alias("__fps"))
    of = lambda t: F.floor(t / block)
    rows = rows.withColumn("__own", of(F.col("__t"))).withColumn("__block", F.explode(F.sequence(of(F.col("__t") - reach), of(F.col("__t") + reach))))

    def filtered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__t", kind="stable")
        own = rows[rows["__own"] == key[-1]]
        out = {k: pd.Series([v] * len(own), dtype=object) for k, v in zip(keys, key)}
        if len(own):
            h = taps(low, high, float(own["__fps"].iloc[0]), seconds)
            first, last = int(own["__t"].iloc[0]), int(own["__t"].iloc[-1])
            wanted = np.arange(first - len(h) // 2, last + len(h) // 2 + 1)
            x = rows["__v"].to_numpy()[np.maximum(np.searchsorted(rows["__t"].to_numpy(), wanted, "right") - 1, 0)]
            n = 1 << (len(x) - 1).bit_length()
            y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[len(h) - 1 : len(x)]
            return pd.DataFrame({**out, time: own["__t"].to_numpy(), value: y[own["__t"].to_numpy() - first]})
        return pd.DataFrame({**out, time: [], value: []})

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys, "__block").applyInPandas(filtered, f"{kinds}, {time} long, {value} double")


def sliding_energies(x: np.ndarray, frames: int, starts: np.ndarray, ks: np.ndarray, n: int) -> np.ndarray:
    """Spectral amplitude at the frequencies ks, summed, of x (frames x components) in the windows that start at starts: each without its mean, times a Hann window, filled up to n points.

    Running sums of x turned by a frequency give the transform of every window as
    a difference of two; those of the neighbouring frequencies make the window.
    """
    if frames < 2:
        return np.zeros((len(starts), x.shape[1]))
    sums = lambda y: np.concatenate([np.zeros((1, *y.shape[1:]), y.dtype), np.cumsum(y, axis=0)])
    plain = sums(x)
    mean = (plain[starts + frames] - plain[starts]) / frames
    t, out = np.arange(len(x)), np.zeros((len(starts), x.shape[1]))
    step = max(1, HELD // x.size)
    for at in range(0, len(ks), step):
        part = ks[at : at + step]
        spectrum = -hann_transform(part, frames, n)[None, :, None] * mean[:, None, :]
        for weight, shift in ((0.5, 0), (-0.25, 1), (-0.25, -1)):
            turn = 2 * np.pi * part / n - shift * 2 * np.pi / (frames - 1)
            run = sums(np.exp(-1j * np.outer(t, turn))[:, :, None] * x[:, None, :])
            spectrum = spectrum + weight * (run[starts + frames] - run[starts]) * np.exp(1j * np.outer(starts, turn))[:, :, None]
        out += np.abs(spectrum).sum(axis=1)
    return out
