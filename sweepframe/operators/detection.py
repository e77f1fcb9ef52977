"""Constant false alarm rate detection, clusters, peaks and targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.functions import kernels
from sweepframe.operators import longseries

HITS = "capture_id string, frame int, doppler_idx int, range_idx int, mag double, label int"


def cfar_columns(grid: DataFrame, guard: int, train: int, factor: float) -> DataFrame:
    """(capture_id, frame, doppler_idx, range_idx, mag, noise, hit) of the interior cells, in window functions alone.

    Sums of boxes are two running sums, first along range, then along Doppler;
    the ring is the outer box without the inner one.
    """
    w = guard + train
    along = Window.partitionBy("capture_id", "frame", "doppler_idx").orderBy("range_idx")
    across = Window.partitionBy("capture_id", "frame", "range_idx").orderBy("doppler_idx")
    x = grid.withColumns({"o": F.sum("mag").over(along.rowsBetween(-w, w)), "i": F.sum("mag").over(along.rowsBetween(-guard, guard)), "nr": F.count("mag").over(along.rowsBetween(-w, w))})
    x = x.withColumns({"oo": F.sum("o").over(across.rowsBetween(-w, w)), "ii": F.sum("i").over(across.rowsBetween(-guard, guard)), "nd": F.count("mag").over(across.rowsBetween(-w, w))})
    side = 2 * w + 1
    x = x.where((F.col("nr") == side) & (F.col("nd") == side)).withColumn("noise", (F.col("oo") - F.col("ii")) / (side**2 - (2 * guard + 1) ** 2))
    return x.select("capture_id", "frame", "doppler_idx", "range_idx", "mag", "noise", (F.col("mag") > F.col("noise") * factor).alias("hit"))


def hits_of(key, found: np.ndarray, guard: int, train: int, factor: float, method: str, share: float = 0.5) -> pd.DataFrame:
    """The detected cells of one map with their cluster."""
    labels = kernels.label4(kernels.detect(found, guard, train, factor, method, share))
    d, r = np.nonzero(labels)
    return pd.DataFrame({"capture_id": key[0], "frame": np.full(len(d), key[1], np.int32), "doppler_idx": d.astype(np.int32), "range_idx": r.astype(np.int32), "mag": found[d, r], "label": labels[d, r]})


def cfar(rd: DataFrame, guard: int = 2, train: int = 8, factor: float = 3.0, method: str = "average", share: float = 0.5) -> DataFrame:
    """Detected cells with cluster labels for maps given as one row of mag by doppler_idx; method average, or ordered: the quantile `share` of the ring (0.5: the median)."""
    if method not in ("average", "ordered"):
        raise ValueError(f"no such method: {method}")

    def frame(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return hits_of(key, np.stack(rows.sort_values("doppler_idx")["mag"].to_numpy()), guard, train, factor, method, share)

    return rd.groupBy("capture_id", "frame").applyInPandas(frame, HITS)


class Detect:
    """CFAR and labels as a further step on each range-Doppler map, without another shuffle."""

    schema = HITS

    def __init__(self, guard: int = 2, train: int = 8, factor: float = 3.0, method: str = "average", share: float = 0.5):
        self.parameters = (guard, train, factor, method, share)

    def __call__(self, key, found: np.ndarray) -> pd.DataFrame:
        return hits_of(key, found, *self.parameters)


def cfar_line(rows: DataFrame, keys: list[str], order: str, value: str, guard: int = 2, train: int = 8, factor: float = 3.0, block: int = 1 << 16) -> DataFrame:
    """One-dimensional CFAR along `order`, a number: interior cells with noise and hit. A series is taken in blocks of so many rows, each with the rows of its neighbours that rings reach, so no task orders it whole."""
    w = guard + train
    of = lambda at: F.floor(at / block)
    x = longseries.positions(rows.select(*keys, order, value), keys, order, "__at").withColumn("__own", of(F.col("__at")))
    x = x.withColumn("__part", F.explode(F.sequence(F.greatest(F.lit(0), of(F.col("__at") - w)), of(F.col("__at") + w))))
    line = Window.partitionBy(*keys, "__part").orderBy("__at")
    left, right = line.rowsBetween(-w, -guard - 1), line.rowsBetween(guard + 1, w)
    x = x.withColumns({"nl": F.count(value).over(left), "nr": F.count(value).over(right), "sl": F.sum(value).over(left), "sr": F.sum(value).over(right)})
    x = x.where((F.col("nl") == train) & (F.col("nr") == train) & (F.col("__own") == F.col("__part"))).withColumn("noise", (F.col("sl") + F.col("sr")) / (2 * train))
    return x.select(*keys, order, value, "noise", (F.col(value) > F.col("noise") * factor).alias("hit"))


def peaks(hits: DataFrame) -> DataFrame:
    """The greatest cell of each cluster, the first in raster order among equals."""
    best = F.max(F.struct("mag", (-F.col("doppler_idx")).alias("d"), (-F.col("range_idx")).alias("r"))).alias("best")
    return hits.groupBy("capture_id", "frame", "label").agg(best).select("capture_id", "frame", "label", (-F.col("best.d")).alias("doppler_idx"), (-F.col("best.r")).alias("range_idx"), F.col("best.mag").alias("magnitude"))


def to_targets(found: DataFrame, range_bins: int, range_step: float, doppler_bins: int, velocity_step: float) -> DataFrame:
    """Peaks with range_m and velocity_ms, null outside the axes."""
    r, d = F.col("range_idx"), F.col("doppler_idx")
    return found.withColumns({"range_m": F.when(r.between(0, range_bins - 1), r * F.lit(range_step)), "velocity_ms": F.when(d.between(0, doppler_bins - 1), (d - doppler_bins // 2) * F.lit(velocity_step))})


def snr_db(magnitude: Column, noise: Column) -> Column:
    """Signal to noise in dB, 0 without noise; minus infinity without a signal."""
    return F.when(noise > 0, F.when(magnitude == 0, float("-inf")).otherwise(20 * F.log10(magnitude / noise))).otherwise(0.0)
