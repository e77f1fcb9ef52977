"""Fast time: range spectra, profiles and range-time maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions import kernels, ranksketch
from sweepframe.functions.percentiles import percentiles
from sweepframe.functions.scratch import materialise
from sweepframe.functions.signal import db20, magnitude
from sweepframe.operators.cube import frame_mean

KEYS = ["capture_id", "frame", "chirp", "rx"]


def range_fft(cube: DataFrame, n_fft: int | None = None, window: str = "hann", remove_dc: bool = True, full: bool = True, real: bool = False, pad_pow2: bool = True) -> DataFrame:
    """The cube with its re and im arrays replaced by the range spectrum; other columns pass.

    n_fft zero-pads or cuts; without it the next power of two, or the number of
    samples. Real samples, and full=False (complex 2x and pseudo-real formats),
    give the half with n/2 + 1 bins. Rows are transformed where they are: no shuffle.
    A null array stays null; rows of different lengths may stand together.
    """

    def transform(batches):
        for whole in batches:
            for _, batch in whole.groupby(whole["re"].map(lambda x: -1 if x is None else len(x))):
                if batch["re"].iloc[0] is None:
                    yield batch
                    continue
                re = np.stack(batch["re"].to_numpy())
                x = re if real else re + 1j * np.stack(batch["im"].to_numpy())
                n = n_fft or (1 << (x.shape[1] - 1).bit_length() if pad_pow2 else x.shape[1])
                out = kernels.spectrum(x, n, window, remove_dc, n if full and not real else n // 2 + 1)
                yield batch.assign(re=list(out.real), im=list(out.imag))

    return cube.mapInPandas(transform, cube.schema)


def with_magnitude(spectra: DataFrame, real: bool = False) -> DataFrame:
    """Spectra -> keys and mag."""
    return spectra.select(*[c for c in spectra.columns if c not in ("re", "im")], magnitude(F.col("re"), F.col("im"), real).alias("mag"))


def cells(rows: DataFrame, into: str = "range_idx", value: str = "mag") -> DataFrame:
    """One row for each element of the array column."""
    return rows.select(*[c for c in rows.columns if c != value], F.posexplode(value).alias(into, value))


def range_m(index: Column, step: float) -> Column:
    return index * F.lit(step)


def mean_arrays(rows: DataFrame, keys: list[str], value: str = "mag") -> DataFrame:
    """(keys, range_idx, value): the mean of each element of the array column over the rows of a key.

    Arrays are added up where the rows are, so one row for each key and task is
    shuffled. Null arrays don't count; the mean of an element is over the arrays
    that reach it.
    """

    def partial(batches):
        for batch in batches:
            batch = batch[batch[value].notna()]
            batch = batch.assign(length=batch[value].map(len))
            found = [(*key[:-1], np.sum(np.stack(part.to_numpy()), axis=0), len(part)) for key, part in batch.groupby([*keys, "length"], dropna=False)[value] if key[-1]]
            if found:
                yield pd.DataFrame(found, columns=[*keys, "total", "n"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    sums = rows.select(*keys, value).mapInPandas(partial, f"{kinds}, total array<double>, n long")
    whole = sums.groupBy(*keys).agg(F.collect_list(F.struct("total", "n")).alias("x"), F.max(F.size("total")).alias("length"))
    element = lambda i, part: F.aggregate("x", F.lit(0.0), lambda s, p: s + F.coalesce(part(p, i), F.lit(0.0)))
    total = lambda i: element(i, lambda p, i: F.get(p["total"], i))
    count = lambda i: element(i, lambda p, i: F.when(i < F.size(p["total"]), p["n"].cast("double")))
    means = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: total(i) / count(i))
    return cells(whole.select(*keys, means.alias(value)), value=value)


def frame_profile(mags: DataFrame) -> DataFrame:
    """(capture_id, frame, range_idx, mag): mean over chirps and receivers."""
    return mean_arrays(mags, ["capture_id", "frame"])


def remove_background(profile: DataFrame, alpha: float) -> DataFrame:
    """Profiles minus alpha times their mean over the frames of the capture, kept at 1e-9 or more."""
    a = min(1.0, max(0.0, alpha))
    ground = profile.groupBy("capture_id", "range_idx").agg(F.avg("mag").alias("ground"))
    return profile.join(ground, ["capture_id", "range_idx"]).select("capture_id", "frame", "range_idx", F.greatest(F.col("mag") - a * F.col("ground"), F.lit(1e-9)).alias("mag"))


def display_limits(rows: DataFrame, value: Column, low: float, high: float, raise_high: float = 0.0) -> DataFrame:
    """Percentiles of the values of each capture, interpolated: the limits of a display."""
    rows = materialise(rows.select("capture_id", value.cast("double").alias("v")))  # both passes read these numbers, not what made them
    p = percentiles(rows, F.col("v"), [low / 100, high / 100])
    return p.select("capture_id", F.col("p")[0].alias("vmin"), (F.col("p")[1] + raise_high).alias("vmax"))


def limits_of_sketch(rows: DataFrame, value: Column, found: DataFrame, low: float, high: float, step: float, raise_high: float = 0.0) -> DataFrame:
    """display_limits by a stored sketch of the values (ranksketch), which new frames have been added to: one pass over the values near the limits."""
    p = ranksketch.exact(rows, value, found, [low / 100, high / 100], step)
    return p.select("capture_id", F.col("p")[0].alias("vmin"), (F.col("p")[1] + raise_high).alias("vmax"))


def range_time(mags: DataFrame, chirps: int) -> DataFrame:
    """(capture_id, t, range_idx, mag): mean over receivers along all chirps, t = frame x chirps + chirp."""
    t = (F.col("frame").cast("long") * chirps + F.col("chirp")).alias("t")
    return mean_arrays(mags.select("capture_id", t, "mag"), ["capture_id", "t"])


def notch(rti: DataFrame, bins: int | str) -> DataFrame:
    """The two first and two last bins set to the first percentile of the bins 10 to bins/2 - 1 (of all bins if there are none) of the whole capture.

    bins: their number, or the name of a column that has it. Maps of at most four bins stay as they are.
    """
    rti = materialise(rti)  # read for the percentile, twice, and for the map
    n, at = (F.col(bins) if isinstance(bins, str) else F.lit(bins)).cast("int"), F.col("range_idx")
    half = F.floor(n / 2)
    low = percentiles(rti.where((half <= 10) | at.between(10, half - 1)), F.col("mag"), [0.01]).select("capture_id", F.col("p")[0].alias("low"))
    edge = (n > 4) & ((at < 2) | (at >= n - 2))
    return rti.join(low, "capture_id").select("capture_id", "t", "range_idx", F.when(edge, F.col("low")).otherwise(F.col("mag")).alias("mag"))


def profile_dbfs(cube: DataFrame, n_fft: int, real: bool = False, remove_dc: bool = True) -> DataFrame:
    """(capture_id, frame, rx, range_idx, dbfs): the coherent mean over chirps, relative to full scale, half spectrum.

    The transform is linear, so samples are averaged first (one aggregate) and
    every frame and receiver is transformed once.
    """
    keys = ["capture_id", "frame", "rx"]
    rows = frame_mean(cube.withColumn("im", F.coalesce("im", F.transform("re", lambda _: F.lit(0.0)))), keys)

    def transform(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["re"].to_numpy()) + 1j * np.stack(batch["im"].to_numpy())
            gain = kernels.window(x.shape[1], "hann").mean()
            out = np.abs(kernels.spectrum(x, n_fft, "hann", remove_dc, n_fft // 2 + 1)) / max(1e-12, n_fft * gain)
            yield pd.DataFrame({**{k: batch[k] for k in keys}, "mag": list(out * (2.0 if real else 1.0))})

    found = rows.mapInPandas(transform, "capture_id string, frame int, rx int, mag array<double>")
    return cells(found).select(*keys, "range_idx", db20(F.col("mag")).alias("dbfs"))

