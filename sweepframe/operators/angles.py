"""Virtual arrays and angle spectra."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.functions import kernels

#: Fixed places of antennas in wavelengths. Receivers and transmitters of the square antenna-on-package grid:
AOP_RX = [(0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5)]
AOP_TX = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]
#: The third transmitter of the 1843 boards stands half a wavelength aside and above.
RAISED_TX = (0.5, 0.5)


def is_safe_tdm(pattern: DataFrame) -> DataFrame:
    """(capture_id, pos, tx_mask) -> (capture_id, safe): two or more places, each of one transmitter, all different."""
    single = (F.col("tx_mask") > 0) & (F.bit_count("tx_mask") == 1)
    return pattern.groupBy("capture_id").agg(((F.count(F.lit(1)) >= 2) & F.bool_and(single) & (F.count(F.lit(1)) == F.countDistinct("tx_mask"))).alias("safe"))


def virtual_array(spectra: DataFrame, stride: int, n_rx: int, mode: str = "MIMO", invert_odd: bool = False) -> DataFrame:
    """(capture_id, frame, chirp, rx, re, im) -> (capture_id, frame, loop, ant, re, im).

    MIMO: antenna = place x receivers + receiver, loop = chirp div stride. First
    TX: place 0 alone. All Chirps: every chirp is a snapshot of the receivers.
    """
    keys = ["capture_id", "frame"]
    place, loop = F.col("chirp") % stride, F.expr(f"cast(chirp div {stride} as int)").alias("loop")
    if mode == "MIMO":
        sign = F.when(place % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0)) if invert_odd else F.lit(1.0)
        turned = (lambda c: F.transform(c, lambda v: v * sign).alias(c)) if invert_odd else F.col
        return spectra.select(*keys, loop, (place * n_rx + F.col("rx")).cast("int").alias("ant"), turned("re"), turned("im"))
    if mode == "First TX":
        return spectra.where(place == 0).select(*keys, loop, F.col("rx").alias("ant"), "re", "im")
    if mode == "All Chirps":
        return spectra.select(*keys, F.col("chirp").alias("loop"), F.col("rx").alias("ant"), "re", "im")
    raise ValueError(f"no such mode: {mode}")


def geometry(n_virtual: int, n_rx: int, platform: str = "", explicit: tuple[list[float], list[float]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the virtual antennas in wavelengths: as given, or by platform, centred on their mean."""
    if explicit and len(explicit[0]) >= n_virtual:
        x = np.array(explicit[0][:n_virtual], float)
        y = np.array(explicit[1][:n_virtual], float) if len(explicit[1]) >= n_virtual else np.zeros(n_virtual)
        return x, y
    n_rx = n_rx or n_virtual
    name, transmitters = platform.upper(), range(n_virtual // n_rx)
    line = [(0.5 * i, 0.0) for i in range(n_rx)]
    in_line = lambda t: (0.5 * n_rx * t, 0.0)
    if "AOP" in name or (n_rx, n_virtual) == (4, 12):
        rx, tx = AOP_RX[:n_rx], lambda t: AOP_TX[t] if t < len(AOP_TX) else (2.0 * t, 0.0)
    elif "1843" in name or (n_rx, n_virtual) == (4, 8):
        rx, tx = line, lambda t: RAISED_TX if t == 2 else in_line(t)
    else:
        rx, tx = line, in_line
    places = np.array([(a + c, b + d) for c, d in map(tx, transmitters) for a, b in rx])[:n_virtual]
    places = places - places.mean(axis=0)
    return places[:, 0], places[:, 1]


def calibration(n_virtual: int, bias_and_phase: list[float] | None = None, rotation: list[float] | None = None) -> np.ndarray | None:
    """Phasors to be multiplied conjugated onto the antennas; None where there are none.

    bias_and_phase: a range bias, then Q and I of each antenna; rotation: radians.
    An antenna without a value is silenced if others have one.
    """
    factors = np.zeros(n_virtual, complex)
    if bias_and_phase is not None and len(bias_and_phase) >= 1 + 2 * n_virtual:
        pairs = np.array(bias_and_phase[1 : 1 + 2 * n_virtual], float).reshape(-1, 2)
        factors = pairs[:, 1] + 1j * pairs[:, 0]
        factors = factors / np.where(factors == 0, 1, np.abs(factors))
    if rotation is not None and len(rotation) >= n_virtual:
        turn = np.exp(1j * np.array(rotation[:n_virtual], float))
        factors = np.where(factors == 0, turn, factors * turn)
    return factors if factors.any() else None


def calibrate(snapshots: DataFrame, factors: np.ndarray | None) -> DataFrame:
    """re and im arrays of each antenna times the conjugated factor."""
    if factors is None:
        return snapshots
    pick = lambda part: F.element_at(F.array(*[F.lit(float(v)) for v in part]), F.col("ant") + 1)
    c, s = pick(factors.real), pick(factors.imag)
    both = snapshots.withColumns({"__c": c, "__s": s})
    re = F.zip_with("re", "im", lambda a, b: a * F.col("__c") + b * F.col("__s"))
    im = F.zip_with("re", "im", lambda a, b: b * F.col("__c") - a * F.col("__s"))
    return both.withColumns({"__re": re, "__im": im}).select("capture_id", "frame", "loop", "ant", F.col("__re").alias("re"), F.col("__im").alias("im"))


def reorder(snapshots: DataFrame, order: list[int], n_virtual: int) -> DataFrame:
    """Antenna k takes the samples of antenna order[k]; nothing if the order doesn't fit."""
    if len(order) != n_virtual:
        return snapshots
    back = F.array(*[F.lit(order.index(k) if k in order else None).cast("int") for k in range(n_virtual)])
    return snapshots.withColumn("ant", F.element_at(back, F.col("ant") + 1)).where("ant is not null")


def static_removed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, loop, re, im) minus their mean over the loops."""
    mean = Window.partitionBy(*keys)
    return rows.withColumns({"re": F.col("re") - F.avg("re").over(mean), "im": F.col("im") - F.avg("im").over(mean)})


def range_bin_at(bins: int, metres: float | None, step: float, default: int) -> int:
    """The bin nearest to a distance (the first of two), clamped to the axis; the default without a distance."""
    nearest = default if metres is None else int(np.argmin(np.abs(np.arange(bins) * step - metres)))
    return max(0, min(bins - 1, nearest))


def _at(snapshots: DataFrame, range_bin: int) -> DataFrame:
    """The scalars of one range bin, which are all that is shuffled."""
    return snapshots.select("capture_id", "frame", "loop", "ant", F.get("re", F.lit(range_bin)).alias("re"), F.get("im", F.lit(range_bin)).alias("im"))


def _loops_of(rows: pd.DataFrame, remove_static: bool) -> np.ndarray:
    """Scalars of one frame -> (loops, antennas)."""
    rows = rows.sort_values(["loop", "ant"])
    z = (rows["re"].to_numpy() + 1j * rows["im"].to_numpy()).reshape(rows["loop"].nunique(), -1)
    return z - z.mean(axis=0) if remove_static else z


def spectrum_at(snapshots: DataFrame, range_bin: int, x: np.ndarray, angles: list[float], remove_static: bool = True) -> DataFrame:
    """(capture_id, frame, angle_deg, db): the Bartlett spectrum at one bin, relative to the frame's maximum: one matrix product for each frame."""
    vectors = kernels.steering(np.asarray(x), np.sin(np.deg2rad(np.asarray(angles, float))))

    def frame(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        db = 10 * np.log10(np.maximum(kernels.bartlett(_loops_of(rows, remove_static)[None], vectors)[0], 1e-12))
        return pd.DataFrame({"capture_id": key[0], "frame": key[1], "db": [db - db.max()]})

    found = _at(snapshots, range_bin).groupBy("capture_id", "frame").applyInPandas(frame, "capture_id string, frame int, db array<double>")
    labels = F.array(*[F.lit(float(a)) for a in angles])
    return found.select("capture_id", "frame", F.posexplode("db").alias("i", "db")).select("capture_id", "frame", F.element_at(labels, F.col("i") + 1).alias("angle_deg"), "db")


def _cube_of(rows: pd.DataFrame) -> np.ndarray:
    """Rows of one frame -> (bins, loops, antennas)."""
    rows = rows.sort_values(["loop", "ant"])
    z = np.stack(rows["re"].to_numpy()) + 1j * np.stack(rows["im"].to_numpy())
    return np.transpose(z.reshape(rows["loop"].nunique(), -1, z.shape[1]), (2, 0, 1))


def range_azimuth(snapshots: DataFrame, x: np.ndarray, angles: np.ndarray | None = None, method: str = "bartlett", remove_static: bool = True, shift: bool = True, relative_db: bool = True) -> DataFrame:
    """(capture_id, frame, range_idx, db array over angles): one map for each frame, relative to its maximum; raw power if not relative_db.

    shift swaps the halves of the azimuth axis and leaves its labels.
    """
    if method not in ("bartlett", "capon"):
        raise ValueError(f"no such method: {method}")
    vectors = kernels.steering(np.asarray(x), np.sin(np.deg2rad(np.arange(-90.0, 91.0) if angles is None else angles)))

    def frame(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        z = _cube_of(rows)
        if remove_static:
            z = z - z.mean(axis=1, keepdims=True)
        p = (kernels.capon if method == "capon" else kernels.bartlett)(z, vectors)
        p = np.fft.fftshift(p, axes=-1) if shift else p
        if relative_db:
            p = 10 * np.log10(np.maximum(p, 1e-12))
            p = p - p.max()
        return pd.DataFrame({"capture_id": key[0], "frame": key[1], "range_idx": np.arange(len(p), dtype=np.int32), "db": list(p)})

    return snapshots.groupBy("capture_id", "frame").applyInPandas(frame, "capture_id string, frame int, range_idx int, db array<double>")


def elevation_beams(x: np.ndarray, y: np.ndarray, az: list[float], el: list[float]) -> np.ndarray:
    """(elevations, azimuths, antennas): conjugated phases of plane waves over antenna places in wavelengths."""
    a, e = np.deg2rad(np.asarray(az, float)), np.deg2rad(np.asarray(el, float))
    return np.exp(-2j * np.pi * (np.sin(a)[None, :, None] * np.cos(e)[:, None, None] * np.asarray(x) + np.sin(e)[:, None, None] * np.asarray(y)))


def elevation_map(snapshot: np.ndarray, beams: np.ndarray, shift: bool = True) -> np.ndarray:
    """Power of a snapshot in all directions, in dB below the maximum; -100 if there is none."""
    p = np.abs(beams @ snapshot) ** 2
    p = np.fft.fftshift(p, axes=1) if shift else p
    return 10 * np.log10(p / p.max() + 1e-12) if p.max() > 0 else np.full(p.shape, -100.0)


def azimuth_elevation(snapshots: DataFrame, range_bin: int, x: np.ndarray, y: np.ndarray, az: list[float], el: list[float], remove_static: bool = False, shift: bool = True) -> DataFrame:
    """(capture_id, frame, el_deg, az_deg, db): power of the mean snapshot over a grid of directions, relative to the frame's maximum (-100 for an empty frame).

    Removing the static part and then averaging leaves nothing but rounding,
    so it isn't the default.
    """
    beams = elevation_beams(x, y, az, el)

    def frame(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        db = elevation_map(_loops_of(rows, remove_static).mean(axis=0), beams, shift)
        return pd.DataFrame({"capture_id": key[0], "frame": key[1], "el_deg": np.asarray(el, float), "db": list(db)})

    found = _at(snapshots, range_bin).groupBy("capture_id", "frame").applyInPandas(frame, "capture_id string, frame int, el_deg double, db array<double>")
    labels = F.array(*[F.lit(float(v)) for v in az])
    return found.select("capture_id", "frame", "el_deg", F.posexplode("db").alias("i", "db")).select("capture_id", "frame", "el_deg", F.element_at(labels, F.col("i") + 1).alias("az_deg"), "db")


def sharpest_order(z: np.ndarray, vectors: np.ndarray, range_bin: int | None = None) -> tuple[list[int], bool]:
    """Order of the antennas of a frame (bins, loops, antennas), and whether conjugated, that makes the sharpest spectrum.

    With a range bin (one-dimensional spectra) sharpness is maximum minus median,
    else the bin of most energy is taken and sharpness is maximum by median.
    Plain before conjugated, orders in lexicographic order; the first best wins.
    """
    at = range_bin if range_bin is not None else int((np.abs(z) ** 2).sum(axis=(1, 2)).argmax())
    strongest = z[at][(np.abs(z[at]) ** 2).sum(axis=1).argmax()]
    orders = list(itertools.permutations(range(z.shape[2])))
    tried = np.concatenate([strongest[np.array(orders)], strongest.conj()[np.array(orders)]])
    power = np.abs(tried @ vectors.conj().T) ** 2
    middle = np.median(power, axis=1)
    k = int((power.max(axis=1) - middle if range_bin is not None else power.max(axis=1) / (middle + 1e-9)).argmax())
    return list(orders[k % len(orders)]), k >= len(orders)


#: Most antennas that are ordered: their orders are all tried.
MOST_ORDERED = 6


def antenna_order(snapshots: DataFrame, x: np.ndarray, range_bin: int | None = None) -> DataFrame:
    """(capture_id, antennas array, conjugated): sharpest_order of each capture's frame 0."""
    vectors = kernels.steering(np.asarray(x), np.sin(np.deg2rad(np.arange(-90.0, 91.0))))

    def best(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *sharpest_order(_cube_of(rows), vectors, range_bin))], columns=["capture_id", "antennas", "conjugated"])

    if len(x) > MOST_ORDERED:
        raise ValueError("at most six antennas can be ordered")
    return snapshots.where("frame = 0").groupBy("capture_id").applyInPandas(best, "capture_id string, antennas array<int>, conjugated boolean")


def apply_order(snapshots: DataFrame, orders: DataFrame) -> DataFrame:
    """Every frame with the order found for its capture (one small row each)."""
    rows = snapshots.join(orders, "capture_id")
    place = (F.array_position("antennas", F.col("ant")) - 1).cast("int")
    im = F.when(F.col("conjugated"), F.transform("im", lambda v: -v)).otherwise(F.col("im"))
    return rows.select("capture_id", "frame", "loop", place.alias("ant"), "re", im.alias("im"))


def _metres(range_step: float | str):
    """Distance of a cell by a range step, or by the column that has it."""
    return F.col("range_idx") * (F.col(range_step) if isinstance(range_step, str) else F.lit(range_step))


def cartesian(cells: DataFrame, range_step: float | str) -> DataFrame:
    """(range_idx, angle_deg) cells with x and y in metres. range_step: metres, or the name of a column."""
    r = _metres(range_step)
    return cells.withColumns({"x_m": r * F.sin(F.radians("angle_deg")), "y_m": r * F.cos(F.radians("angle_deg"))})


def crop(cells: DataFrame, range_step: float | str, nearest: float = 0.3, span_db: float = 35.0) -> DataFrame:
    """Cells from a least distance on (all, if none is that far), raised to the frame's maximum minus a span."""
    w = Window.partitionBy("capture_id", "frame")
    far = _metres(range_step) >= nearest
    kept = cells.withColumn("__any", F.max(far).over(w)).where(far | ~F.col("__any")).drop("__any")
    return kept.withColumn("db", F.greatest(F.col("db"), F.max("db").over(w) - span_db))
