"""The workloads from recorded captures: each is decoded and processed with the settings of its own log, many captures in one job.

A task reads its frames as ranges of bytes (or is given their words), and does
all that concerns one frame: decoding, spectra, detection, maps. Only targets,
maps and profiles leave it; raw samples are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.functions import kernels
from sweepframe.functions.scratch import join_small, materialise
from sweepframe.functions.signal import C0, bin_width_m, velocity_step
from sweepframe.operators import angles, detection, doppler, logconfig, ranges, temporal
from sweepframe.sources import captures

#: What a task must know of a capture.
SETTINGS = ["lanes", "n_samples", "n_rx", "chirps", "stride", "tx_masks", "interleaved", "real", "full", "swap", "bits", "frames", "frame_words", "start_hz", "slope", "rate", "idle_s", "ramp_s", "fps", "chip", "bias_phase", "rotation", "places_x", "places_y"]
RANGES_A_TASK = 4


def settings(lines: DataFrame) -> DataFrame:
    """(capture_id, line_no, line) -> capture_id, SETTINGS, and reason: why a capture can't be decoded, null if it can.

    Captures without a valid profile have no row. Interleaved, IQ and 16 bits
    where the log doesn't say; one frame where it declares none.
    """
    c = logconfig.captures(lines)
    real = F.coalesce(F.upper("adc_fmt") == "REAL", F.lit(False))
    found = c.select(
        "capture_id", "chip", F.col("num_lanes").cast("int").alias("lanes"), F.col("num_samples").cast("int").alias("n_samples"), F.col("num_rx").cast("int").alias("n_rx"), F.col("chirps_per_frame").cast("int").alias("chirps"),
        F.col("unique_chirps").cast("int").alias("stride"), F.col("tx_masks").cast("array<int>").alias("tx_masks"), F.coalesce("interleaved", F.lit(True)).alias("interleaved"), real.alias("real"), (F.coalesce("adc_fmt", F.lit("Complex1X")) == "Complex1X").alias("full"),
        F.coalesce(F.col("iq_order") == "QI", F.lit(False)).alias("swap"), F.coalesce("adc_bits", F.lit(16)).cast("int").alias("bits"), F.col("frames").cast("long").alias("frames"),
        (F.col("chirps_per_frame") * F.col("num_rx") * F.col("num_samples") * F.when(real, 1).otherwise(2)).cast("long").alias("frame_words"),
        (F.col("start_freq_ghz") * 1e9).alias("start_hz"), (F.col("slope_mhz_us") * 1e12).alias("slope"), F.coalesce(F.col("fs_mhz") * 1e6, F.lit(0.0)).alias("rate"), (F.col("idle_us") / 1e6).alias("idle_s"), (F.col("ramp_us") / 1e6).alias("ramp_s"), "fps",
        F.col("compRangeBiasAndRxChanPhase").alias("bias_phase"), F.col("antPhaseRot").alias("rotation"), F.col("antGeometry0").alias("places_x"), F.col("antGeometry1").alias("places_y"),
    )
    group = F.col("lanes") * F.when(F.col("real"), 1).otherwise(2)
    reason = F.when(~F.coalesce(F.col("lanes").isin(1, 2, 4), F.lit(False)), "lanes").when(~F.coalesce(F.col("n_samples") > 0, F.lit(False)), "samples").when(F.coalesce(F.col("chirps") < 1, F.lit(True)), "chirps").when(F.col("frame_words") % group != 0, "lane groups")
    return found.withColumn("reason", reason)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of a folder with the settings of their logs: capture_id (the path of the first file), parts, length, SETTINGS, reason (`log` for a recording without one).

    The files X_Raw_0.bin, X_Raw_1.bin, ... are one recording, whose frames may
    cross from one to the next; `parts` is the reason if one of them is missing.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    numbered = F.regexp_extract("path", r"_Raw_(\d+)\.bin$", 1)
    found = found.withColumn("number", numbered).withColumn("of", F.when(F.col("number") != "", F.regexp_replace("path", r"\d+\.bin$", "")).otherwise(F.col("path"))).withColumn("part", F.coalesce(F.expr("try_cast(number as int)"), F.lit(0)))
    parts = found.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("part", "path", "length"))).alias("parts"), F.sum("length").alias("length"), (F.max("part") + 1 == F.count(F.lit(1))).alias("whole"))
    # sums of the lengths of the files before each are an index from a frame to its bytes
    start = lambda p, i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda s, q: s + q["length"])
    parts = parts.withColumn("parts", F.transform("parts", lambda p, i: F.struct(p["path"].alias("path"), p["length"].alias("length"), start(p, i).alias("start"))))
    cut = lambda c, n: F.regexp_extract(c, r"^(.*)/([^/]*)$", n)
    path = F.col("parts")[0]["path"]
    parts = parts.select(path.alias("capture_id"), "parts", "length", "whole", F.concat(cut(path, 1), F.lit("/"), captures.log_name(cut(path, 2))).alias("log"))
    lines = captures.read_logs(spark, f"{folder}/*_LogFile.txt").withColumnRenamed("path", "log")
    known = settings(parts.join(lines, "log").select("capture_id", "line_no", "line"))
    why = F.when(~F.col("whole"), "parts").when(F.col("frame_words").isNull() & F.col("reason").isNull(), "log").otherwise(F.col("reason"))
    return parts.drop("log").join(known, "capture_id", "left").withColumn("reason", why).drop("whole")


def splits(found: DataFrame, declared: bool = True) -> DataFrame:
    """Ranges of frames of the recordings that can be decoded, with the pieces of files that hold them. declared: at most the frames that the log declares; a frame cut short at the end is dropped."""
    whole = F.expr("length div (2 * frame_words)")
    n = F.least(whole, F.col("frames")) if declared else whole
    rows = found.where("reason is null").withColumn("__n", n).withColumn("__step", F.greatest(F.lit(1), F.expr(f"{captures.SPLIT} div (2 * frame_words)"))).where("__n > 0")
    rows = rows.withColumn("first", F.explode(F.expr("sequence(0L, __n - 1, __step)"))).withColumn("count", F.least("__step", F.col("__n") - F.col("first")))
    begin, end = F.col("first") * 2 * F.col("frame_words"), (F.col("first") + F.col("count")) * 2 * F.col("frame_words")
    low, high = lambda p: F.greatest(begin, p["start"]), lambda p: F.least(end, p["start"] + p["length"])
    pieces = F.transform(F.filter("parts", lambda p: low(p) < high(p)), lambda p: F.struct(p["path"].alias("path"), (low(p) - p["start"]).alias("offset"), (high(p) - low(p)).alias("bytes")))
    rows = rows.select("capture_id", pieces.alias("pieces"), "first", "count", *SETTINGS)
    return rows.repartition(max(1, rows.count() // RANGES_A_TASK), "capture_id", "first")


def cut_words(words: DataFrame, known: DataFrame, declared: bool = True) -> DataFrame:
    """(capture_id, word_idx, v) -> whole frames (capture_id, first, words) with SETTINGS."""
    rows = words.join(known.where("reason is null"), "capture_id").withColumn("first", F.expr("word_idx div frame_words"))
    rows = rows.where("first < frames") if declared else rows
    values = F.array_sort(F.collect_list(F.struct("word_idx", "v")))["v"]
    settled = [F.first(c).alias(c) for c in SETTINGS]
    return rows.groupBy("capture_id", "first").agg(values.alias("words"), *settled).where("size(words) = frame_words")


def _frames(row: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(frame, words) of a range of files, or of a row that has its words."""
    if row.get("pieces") is None:
        return iter([(int(row["first"]), np.asarray(row["words"]))])
    return captures.read_frames([(p["path"], p["offset"], p["bytes"]) for p in row["pieces"]], int(row["first"]), int(row["count"]), 2 * int(row["frame_words"]))


def by_frame(rows: DataFrame, step: Callable[[dict, int, np.ndarray], pd.DataFrame], schema: str, lane_order: list[int] | None = None) -> DataFrame:
    """step(settings, frame, samples as chirps x receivers x samples) for every frame of splits or cut_words."""

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                for frame, words in _frames(row):
                    x = kernels.samples(words[None], row["lanes"], row["n_samples"], row["n_rx"], row["chirps"], row["interleaved"], row["real"], row["swap"], lane_order, max(1, 2 ** (row["bits"] - 1) - 1))
                    yield step(row, frame, x[0])

    return rows.mapInPandas(run, schema)


def range_spectra(s: dict, x: np.ndarray, n_fft: int | None, half: bool = False) -> np.ndarray:
    """Range spectra of all chirps and receivers; n_fft None: the next power of two."""
    n = n_fft or 1 << (x.shape[-1] - 1).bit_length()
    return kernels.spectrum(x, n, "hann", True, n if s["full"] and not s["real"] and not half else n // 2 + 1)


def one_transmitter(s: dict, x: np.ndarray) -> tuple[np.ndarray, int]:
    """(loops, receivers, samples) of one transmitter and the chirps of a loop; every second chirp where the pattern doesn't divide them."""
    stride = s["stride"]
    if len(x) % stride:
        return x[::2], 2
    places = doppler.transmit_positions(None if s["tx_masks"] is None else [int(m) for m in s["tx_masks"]], stride)
    return x.reshape(-1, stride, *x.shape[1:])[:, [p for p in places if p < stride]].mean(axis=1), stride


def of_transmitter(s: dict, x: np.ndarray, transmitter: int | None) -> np.ndarray:
    """The chirps at the places of the pattern at which this transmitter alone sends; all chirps if there is no such place, or the pattern doesn't divide them."""
    masks = [] if s["tx_masks"] is None else [int(m) for m in s["tx_masks"]]
    places = [p for p, m in enumerate(masks[: s["stride"]]) if transmitter is not None and m == 1 << transmitter]
    return x.reshape(-1, s["stride"], *x.shape[1:])[:, places].reshape(-1, *x.shape[1:]) if places and len(x) % s["stride"] == 0 else x


def doppler_map(s: dict, x: np.ndarray, n_fft: int | None, mode: str = "MRC", transmitter: int | None = None) -> tuple[np.ndarray, float]:
    """(Doppler, range) magnitudes of a frame, and m/s of a Doppler bin; of the transmitter chosen, or of the first usable one."""
    chosen = of_transmitter(s, x, transmitter)
    places = max(1, len(x) // len(chosen))
    loops, chirps = one_transmitter(s, x) if chosen is x else (chosen, places)
    z = np.moveaxis(range_spectra(s, loops, n_fft), 0, -1)
    found = doppler.combine(kernels.doppler(z, z.shape[-1], "hann"), mode).T
    return found, velocity_step(len(found), (s["idle_s"] + s["ramp_s"]) * chirps, s["start_hz"])


def targets(rows: DataFrame, n_fft: int | None = 256, guard: int = 2, train: int = 8, factor: float = 3.0, method: str = "average") -> DataFrame:
    """(capture_id, frame, label, doppler_idx, range_idx, magnitude, range_m, velocity_ms): the peak of each cluster of detected cells, the first in raster order among equals."""
    if method not in ("average", "ordered"):
        raise ValueError(f"no such method: {method}")

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        found, step_v = doppler_map(s, x, n_fft)
        hits = detection.hits_of((s["capture_id"], frame), found, guard, train, factor, method)
        top = hits.loc[hits.groupby("label")["mag"].idxmax()].rename(columns={"mag": "magnitude"})
        width = bin_width_m(n_fft or 1 << (s["n_samples"] - 1).bit_length(), s["rate"], s["slope"])
        return top.assign(range_m=top["range_idx"] * width, velocity_ms=(top["doppler_idx"] - len(found) // 2) * step_v)[["capture_id", "frame", "label", "doppler_idx", "range_idx", "magnitude", "range_m", "velocity_ms"]]

    return by_frame(rows, step, "capture_id string, frame int, label int, doppler_idx int, range_idx int, magnitude double, range_m double, velocity_ms double")


def range_doppler(rows: DataFrame, n_fft: int | None = 256, mode: str = "MRC", transmitter: int | None = None) -> DataFrame:
    """(capture_id, frame, doppler_idx, mag array over range)."""

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        found, _ = doppler_map(s, x, n_fft, mode, transmitter)
        return pd.DataFrame({"capture_id": s["capture_id"], "frame": np.int32(frame), "doppler_idx": np.arange(len(found), dtype=np.int32), "mag": list(found)})

    return by_frame(rows, step, "capture_id string, frame int, doppler_idx int, mag array<double>")


def micro_doppler(rows: DataFrame, first: int = 5, last: int = 100, n_fft: int | None = 256, transmitter: int | None = None) -> DataFrame:
    """(capture_id, frame, doppler_idx, db): the sum of each map over range bins first to last."""
    return doppler.micro_doppler(range_doppler(rows, n_fft, transmitter=transmitter), first, last)


def frame_profiles(rows: DataFrame, n_fft: int | None = 256, alpha: float | None = None, transmitter: int | None = None) -> DataFrame:
    """(capture_id, frame, range_idx, mag): mean magnitudes over chirps and receivers, minus alpha times the recording's mean over its frames."""

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        mag = (np.abs(range_spectra(s, of_transmitter(s, x, transmitter), n_fft)) + 1e-9) * (2.0 if s["real"] else 1.0)
        return pd.DataFrame({"capture_id": s["capture_id"], "frame": np.int32(frame), "mag": [mag.mean(axis=(0, 1))]})

    found = ranges.cells(by_frame(rows, step, "capture_id string, frame int, mag array<double>"))
    return found if alpha is None else ranges.remove_background(materialise(found), alpha)


def profile_dbfs(rows: DataFrame, n_fft: int | None = 256, transmitter: int | None = None, remove_dc: bool = True) -> DataFrame:
    """(capture_id, frame, rx, range_idx, dbfs): the coherent mean over chirps relative to full scale, half spectrum."""

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        mean = of_transmitter(s, x, transmitter).mean(axis=0)
        n = n_fft or 1 << (mean.shape[-1] - 1).bit_length()
        gain = max(1e-12, n * kernels.window(mean.shape[-1], "hann").mean())
        out = np.abs(kernels.spectrum(mean, n, "hann", remove_dc, n // 2 + 1)) / gain * (2.0 if s["real"] else 1.0)
        return pd.DataFrame({"capture_id": s["capture_id"], "frame": np.int32(frame), "rx": np.arange(len(out), dtype=np.int32), "mag": list(20 * np.log10(out + 1e-9))})

    found = by_frame(rows, step, "capture_id string, frame int, rx int, mag array<double>")
    return ranges.cells(found).withColumnRenamed("mag", "dbfs")


def safe_tdm(masks: list[int] | None) -> bool:
    """Two or more places of one transmitter each, all different."""
    active = [int(m) for m in (masks if masks is not None else [])]
    return len(active) >= 2 and all(m > 0 and m.bit_count() == 1 for m in active) and len(set(active)) == len(active)


def virtual_array(s: dict, z: np.ndarray, mode: str = "MIMO") -> np.ndarray:
    """(chirps, receivers, bins) -> (bins, loops, antennas). MIMO only for a safe pattern that divides the chirps; else all chirps are snapshots of the receivers."""
    stride = s["stride"]
    if mode not in ("MIMO", "First TX", "All Chirps"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "MIMO" and len(z) % stride == 0 and s["tx_masks"] is not None and len(s["tx_masks"]) == stride and safe_tdm(s["tx_masks"]):
        z = z.reshape(len(z) // stride, stride * z.shape[1], -1)
    elif mode == "First TX":
        z = z[::stride]
    return np.moveaxis(z, 2, 0)


def antennas(s: dict, x: np.ndarray, n_fft: int | None, mode: str = "MIMO", order: list[int] | None = None, calibrated: bool = True, half: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A frame as (bins, loops, antennas), and the places of the antennas in wavelengths.

    The antennas are in the given order, or the one found for the capture
    (with_orders), if it fits, are turned by the calibration of the log, and
    stand where the log says or else where the chip has them.
    """
    z = virtual_array(s, range_spectra(s, x, n_fft, half), mode)
    n, given = z.shape[-1], lambda name: None if s.get(name) is None else list(s[name])
    found = given("antennas")
    if order and len(order) == n:
        z = z[..., order]
    elif not order and found and len(found) == n:
        z = z[..., found].conj() if s["conjugated"] else z[..., found]
    turn = angles.calibration(n, given("bias_phase"), given("rotation")) if calibrated else None
    z = z if turn is None else z * turn.conj()
    explicit = (given("places_x"), given("places_y") or []) if given("places_x") else None
    return z, *angles.geometry(n, s["n_rx"], s["chip"] or "", explicit)


def antenna_orders(rows: DataFrame, n_fft: int | None = 256, mode: str = "MIMO", metres: float | None = None) -> DataFrame:
    """(capture_id, antennas, conjugated): the order that makes the sharpest spectrum on frame 0 of each recording, at a distance or at the bin of most energy. Recordings of more than six antennas have none."""
    sines = np.sin(np.deg2rad(np.arange(-90.0, 91.0)))

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        z, places, _ = antennas(s, x, n_fft, mode, calibrated=False, half=metres is None)
        if len(places) > angles.MOST_ORDERED:
            return pd.DataFrame({"capture_id": [], "antennas": [], "conjugated": []}, dtype=object)
        found = angles.sharpest_order(z, kernels.steering(places, sines), None if metres is None else bin_at(s, n_fft, len(z), metres))
        return pd.DataFrame([(s["capture_id"], *found)], columns=["capture_id", "antennas", "conjugated"])

    first = rows.where("first = 0")
    first = first.withColumn("count", F.lit(1).cast("long")) if "count" in first.columns else first
    return by_frame(first, step, "capture_id string, antennas array<int>, conjugated boolean")


def with_orders(rows: DataFrame, n_fft: int | None = 256, mode: str = "MIMO", metres: float | None = None) -> DataFrame:
    """rows with the antenna order of their recording: found on the first frame, sent to all ranges."""
    return join_small(rows, materialise(antenna_orders(rows, n_fft, mode, metres)), "capture_id", "left")


def bin_at(s: dict, n_fft: int | None, bins: int, metres: float | None) -> int:
    """The range bin nearest to a distance by the recording's own range step; the middle one without a distance."""
    return angles.range_bin_at(bins, metres, bin_width_m(n_fft or 1 << (s["n_samples"] - 1).bit_length(), s["rate"], s["slope"]), bins // 2)


def range_azimuth(rows: DataFrame, n_fft: int | None = 256, method: str = "bartlett", mode: str = "MIMO", order: list[int] | str | None = None, calibrated: bool = True, remove_static: bool = True, shift: bool = True) -> DataFrame:
    """(capture_id, frame, range_idx, fps, db array over -90 to 90 degrees): half-spectrum maps relative to their maximum. order `auto`: as with_orders finds it."""
    if method not in ("bartlett", "capon"):
        raise ValueError(f"no such method: {method}")
    sines = np.sin(np.deg2rad(np.arange(-90.0, 91.0)))
    rows, order = (with_orders(rows, n_fft, mode), None) if order == "auto" else (rows, order)

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        z, places, _ = antennas(s, x, n_fft, mode, order, calibrated, half=True)
        z = z - z.mean(axis=1, keepdims=True) if remove_static else z
        p = (kernels.capon if method == "capon" else kernels.bartlett)(z, kernels.steering(places, sines))
        db = 10 * np.log10(np.maximum(np.fft.fftshift(p, axes=-1) if shift else p, 1e-12))
        return pd.DataFrame({"capture_id": s["capture_id"], "frame": np.int32(frame), "range_idx": np.arange(len(db), dtype=np.int32), "fps": s["fps"], "db": list(db - db.max())})

    return by_frame(rows, step, "capture_id string, frame int, range_idx int, fps double, db array<double>")


def angle_spectrum(rows: DataFrame, metres: float | None = None, n_fft: int | None = 256, mode: str = "MIMO", order: list[int] | str | None = None, calibrated: bool = True, remove_static: bool = True) -> DataFrame:
    """(capture_id, frame, range_idx, db array over -90 to 90 degrees): the Bartlett spectrum at a distance, relative to the frame's maximum."""
    sines = np.sin(np.deg2rad(np.arange(-90.0, 91.0)))
    rows, order = (with_orders(rows, n_fft, mode, metres), None) if order == "auto" else (rows, order)

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        z, places, _ = antennas(s, x, n_fft, mode, order, calibrated)
        at = bin_at(s, n_fft, len(z), metres)
        z = z[at : at + 1] - (z[at].mean(axis=0) if remove_static else 0)
        db = 10 * np.log10(np.maximum(kernels.bartlett(z, kernels.steering(places, sines))[0], 1e-12))
        return pd.DataFrame({"capture_id": s["capture_id"], "frame": np.int32(frame), "range_idx": np.int32(at), "db": [db - db.max()]})

    return by_frame(rows, step, "capture_id string, frame int, range_idx int, db array<double>")


def azimuth_elevation(rows: DataFrame, az: list[float], el: list[float], metres: float | None = None, n_fft: int | None = 256, mode: str = "MIMO", calibrated: bool = True, shift: bool = True) -> DataFrame:
    """(capture_id, frame, range_idx, el_deg, db array over az): power of the mean snapshot at a distance over a grid of directions."""

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        z, px, py = antennas(s, x, n_fft, mode, None, calibrated)
        at = bin_at(s, n_fft, len(z), metres)
        db = angles.elevation_map(z[at].mean(axis=0), angles.elevation_beams(px, py, az, el), shift)
        return pd.DataFrame({"capture_id": s["capture_id"], "frame": np.int32(frame), "range_idx": np.int32(at), "el_deg": np.asarray(el, float), "db": list(db)})

    return by_frame(rows, step, "capture_id string, frame int, range_idx int, el_deg double, db array<double>")


def frame_counts(rows: DataFrame) -> DataFrame:
    """(capture_id, frames) of splits or cut_words."""
    last = F.col("first") + (F.col("count") if "count" in rows.columns else F.lit(1))
    return rows.groupBy("capture_id").agg(F.max(last).cast("int").alias("frames"))


def movement(rows: DataFrame, n_fft: int | None = 256, band: str = "movement", **how) -> DataFrame:
    """(capture_id, range_idx, angle_idx, db): the movement map of each capture at its own frame rate; one shuffle of maps."""
    return temporal.movement_map(range_azimuth(rows, n_fft, **how), band, "fps", counts=frame_counts(rows))


def movement_by_window(rows: DataFrame, n_fft: int | None = 256, frames: int = 32, hop: int | None = None, band: str = "movement", **how) -> DataFrame:
    """(capture_id, window_idx, range_idx, angle_idx, db): the movement map of each window of frames, at the recording's own frame rate."""
    return temporal.movement_by_window(range_azimuth(rows, n_fft, **how), frames, hop, band, "fps")


def displacement(rows: DataFrame, metres: float | None = None, n_fft: int | None = 256) -> DataFrame:
    """(capture_id, rx, t, fps, displacement_m): unwrapped phase of each frame's first chirp of one transmitter at a distance, in metres by the recording's own wavelength; t counts frames."""

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        z = range_spectra(s, one_transmitter(s, x)[0][:1], n_fft)[0]
        z = z[:, bin_at(s, n_fft, z.shape[1], metres)]
        return pd.DataFrame({"capture_id": s["capture_id"], "rx": np.arange(len(z), dtype=np.int32), "t": np.int64(frame), "fps": s["fps"], "wavelength": C0 / s["start_hz"], "re": z.real, "im": z.imag})

    cells = materialise(by_frame(rows, step, "capture_id string, rx int, t long, fps double, wavelength double, re double, im double"))
    return join_small(temporal.phase_displacement(cells, "wavelength"), materialise(cells.groupBy("capture_id").agg(F.max("fps").alias("fps"))), "capture_id")


def profiles(rows: DataFrame, n_fft: int | None = 256) -> DataFrame:
    """(capture_id, frame, fps, mag array): the mean over Doppler."""

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"capture_id": s["capture_id"], "frame": np.int32(frame), "fps": s["fps"], "mag": [doppler_map(s, x, n_fft)[0].mean(axis=0)]})

    return by_frame(rows, step, "capture_id string, frame int, fps double, mag array<double>")


def vital_signs(rows: DataFrame, n_fft: int | None = 256, bin_: int | None = None, around: int = 0) -> DataFrame:
    """Vital signs of each capture at its own frame rate, at a bin, near it, or over all bins."""
    return temporal.vitals(temporal.profile_signal(profiles(rows, n_fft), bin_, around), "fps")


def range_time(rows: DataFrame, n_fft: int | None = 256) -> DataFrame:
    """(capture_id, t, range_idx, mag): notched range-time maps, each by its own number of bins."""

    def step(s: dict, frame: int, x: np.ndarray) -> pd.DataFrame:
        mag = ((np.abs(range_spectra(s, x, n_fft)) + 1e-9) * (2.0 if s["real"] else 1.0)).mean(axis=1)
        return pd.DataFrame({"capture_id": s["capture_id"], "t": frame * len(mag) + np.arange(len(mag)), "bins": np.int32(mag.shape[1]), "mag": list(mag)})

    return ranges.notch(ranges.cells(by_frame(rows, step, "capture_id string, t long, bins int, mag array<double>")), "bins")
