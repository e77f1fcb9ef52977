"""Across frames: movement maps, vital signs, phase."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.functions.scratch import join_small, materialise
from sweepframe.operators import longseries
from sweepframe.operators.longseries import fft_size

FPS = 15.0
#: Points of a transform up to which one group holds all frames of a capture; longer ones take two steps.
LONGEST = 1 << 15
#: Hz of the two bands of vital signs; heart rates end at half the frame rate, too.
BREATHING, HEART = (0.1, 0.6), (0.8, 3.5)


def in_band(hz: Column, band: str, nyquist: float) -> Column:
    """Whether a frequency belongs to a band; 0.6 Hz belongs to two."""
    bands = {
        "noise": (hz >= 0.0) & (hz < 0.1),
        "breathing": (hz >= 0.1) & (hz <= 0.6),
        "hr": (hz >= 0.8) & (hz <= min(3.5, nyquist)),
        "movement": ((hz >= 0.6) & (hz < 0.8)) | (hz > 3.5),
    }
    return bands[band]


def band_mask(hz: np.ndarray, band: str, nyquist: float | None = None) -> np.ndarray:
    """in_band of a spectrum's frequencies; nyquist: the last of them, where these are only some."""
    nyquist = nyquist if nyquist is not None else hz[-1] if len(hz) else 0.0
    return {
        "noise": (hz >= 0.0) & (hz < 0.1),
        "breathing": (hz >= 0.1) & (hz <= 0.6),
        "hr": (hz >= 0.8) & (hz <= min(3.5, nyquist)),
        "movement": ((hz >= 0.6) & (hz < 0.8)) | (hz > 3.5),
    }[band]


#: Angles that a group of the movement map holds, and bins of the band in one row of partial sums.
ANGLE_BLOCK, BIN_BLOCK = 16, 16
#: Points of windows that are transformed at a time.
WINDOWS = 1 << 16
#: Bins of a band up to which a capture's map is made of partial sums.
MOST_BINS = 64
#: Bytes of partial sums that a task holds before it hands them on.
HELD = 64 << 20


def _rate(fps: float | str) -> Column:
    """A frame rate for all captures, or the column that has it."""
    return (F.col(fps) if isinstance(fps, str) else F.lit(float(fps))).alias("fps")


def _blocks(ra: DataFrame, fps: float | str, *more: str) -> DataFrame:
    """The maps of a frame in pieces of ANGLE_BLOCK angles."""
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(db) - 1) div {ANGLE_BLOCK}")), lambda b: F.slice("db", (b * ANGLE_BLOCK + 1).cast("int"), ANGLE_BLOCK))
    return ra.select("capture_id", "frame", "range_idx", *more, _rate(fps), F.posexplode(cut).alias("block", "db"))


def _long(frames: Column, longest: int) -> Column:
    return longseries.fft_size_of(frames) > longest


def movement_map(ra: DataFrame, band: str = "movement", fps: float | str = FPS, in_db: bool = True, counts: DataFrame | None = None, longest: int = LONGEST) -> DataFrame:
    """(capture_id, range_idx, angle_idx, db): spectral amplitude of each cell over the frames in a band, relative to the capture's maximum.

    One shuffle turns frames of maps into series by range bin and block of
    angles; such a group holds frames x ANGLE_BLOCK numbers. Captures of which
    the transform has more than longest points are transformed in two steps
    (longseries.amplitudes), so no group or row has all their frames. counts:
    (capture_id, frames), where they can be had for less than writing ra once.
    fps: a number, or the name of a column of ra. Frames are numbered from 0
    without gaps. An empty table gives an empty map.
    """
    if counts is None:
        ra = materialise(ra)
        counts = ra.groupBy("capture_id").agg((F.max("frame") + 1).cast("int").alias("frames"))
    counts = counts.select("capture_id", F.col("frames").cast("int").alias("frames"), _long(F.col("frames"), longest).alias("long"))  # a row for each capture
    kinds = {r["long"] for r in counts.select("long").distinct().collect()}

    def pixels(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("frame")["db"].to_numpy())
        x = 10 ** (x / 10) if in_db else x
        x = (x - x.mean(axis=0)) * np.hanning(len(x))[:, None]
        n = fft_size(len(x))
        energy = np.abs(np.fft.rfft(x, n=n, axis=0))[band_mask(np.fft.rfftfreq(n, 1 / rows["fps"].iloc[0]), band)].sum(axis=0)
        return pd.DataFrame({"capture_id": key[0], "range_idx": np.int32(key[1]), "angle_idx": (key[2] * ANGLE_BLOCK + np.arange(len(energy))).astype(np.int32), "e": energy})

    def part(key: tuple, k: np.ndarray, found: np.ndarray, n: int, fps: float) -> pd.DataFrame:
        step = 1.0 / (n * (1 / fps))
        energy = found[band_mask(k * step, band, n // 2 * step)].sum(axis=0)
        return pd.DataFrame({"capture_id": key[0], "range_idx": np.int32(key[1]["range_idx"]), "angle_idx": (key[1]["block"] * ANGLE_BLOCK + np.arange(len(energy))).astype(np.int32), "e": energy})

    schema = "capture_id string, range_idx int, angle_idx int, e double"
    whole = lambda rows: _blocks(rows, fps).groupBy("capture_id", "range_idx", "block").applyInPandas(pixels, schema)

    def in_steps(rows: DataFrame) -> DataFrame:
        x = F.transform("db", lambda v: F.pow(F.lit(10.0), v / 10)) if in_db else F.col("db")
        cells = _blocks(rows, fps, "frames").select("capture_id", F.struct("range_idx", "block").alias("cell"), "frame", "frames", "fps", x.alias("x"))
        return longseries.amplitudes(cells, part, schema).groupBy("capture_id", "range_idx", "angle_idx").agg(F.sum("e").alias("e"))

    if True not in kinds:
        return _relative(whole(ra))
    known = join_small(ra, materialise(counts), "capture_id")
    if False not in kinds:
        return _relative(in_steps(known))
    return _relative(whole(known.where("not long").drop("long", "frames")).unionByName(in_steps(known.where("long"))))


def movement_by_window(ra: DataFrame, frames: int = 32, hop: int | None = None, band: str = "movement", fps: float | str = FPS, in_db: bool = True, block: int = 256) -> DataFrame:
    """(capture_id, window_idx, range_idx, angle_idx, db): the movement map of each whole window of frames, every hop frames (hop None: windows that follow each other), relative to the window's maximum.

    A group is a range bin, a block of angles and a block of time, with the
    frames that its windows reach into the next block. Within it windows are
    differences of running sums (longseries.sliding_energies), so a window costs
    the same however long it is. Windows with a missing frame are left out.
    """
    hop = hop or frames
    many = max(1, block // hop)
    first, last = F.greatest(F.lit(0), F.ceil((F.col("frame") - (frames - 1)) / hop)).cast("int"), F.expr(f"cast(frame div {hop} as int)")
    rows = _blocks(ra, fps).withColumns({"__first": first, "__last": last}).where("__first <= __last")
    rows = rows.withColumn("part", F.explode(F.sequence(F.expr(f"__first div {many}"), F.expr(f"__last div {many}")))).drop("__first", "__last")

    def windows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base = int(key[3]) * many * hop
        at, values = rows["frame"].to_numpy() - base, np.stack(rows["db"].to_numpy())
        x = np.zeros(((many - 1) * hop + frames, values.shape[1]))
        there = np.zeros(len(x), int)
        x[at], there[at] = 10 ** (values / 10) if in_db else values, 1
        so_far = np.append(0, np.cumsum(there))
        starts = np.arange(many) * hop
        starts = starts[so_far[starts + frames] - so_far[starts] == frames]
        n = fft_size(frames)
        ks = np.flatnonzero(band_mask(np.fft.rfftfreq(n, 1 / rows["fps"].iloc[0]), band))
        e = longseries.sliding_energies(x, frames, starts, ks, n)
        return pd.DataFrame({
            "capture_id": key[0], "window_idx": np.repeat((base + starts) // hop, e.shape[1]).astype(np.int32), "range_idx": np.int32(key[1]),
            "angle_idx": np.tile(key[2] * ANGLE_BLOCK + np.arange(e.shape[1]), len(starts)).astype(np.int32), "e": e.ravel(),
        })

    found = rows.groupBy("capture_id", "range_idx", "block", "part").applyInPandas(windows, "capture_id string, window_idx int, range_idx int, angle_idx int, e double")
    return _relative(found, "window_idx")


def _relative(found: DataFrame, *keys: str) -> DataFrame:
    """In dB below the maximum of the map, which is as large as range bins x angles whatever the frames."""
    db = lambda e: 10 * F.log10(e + 1e-12)
    return found.select("capture_id", *keys, "range_idx", "angle_idx", (db(F.col("e")) - db(F.max("e").over(Window.partitionBy("capture_id", *keys)))).alias("db"))


def movement_map_by_sums(ra: DataFrame, band: str = "movement", fps: float = FPS, in_db: bool = True, counts: DataFrame | None = None, most: int = MOST_BINS) -> DataFrame:
    """movement_map by partial sums: the DFT is linear, so each task adds up its frames for each bin of the band. For narrow bands: traffic is bins of the band x tasks, instead of frames.

    X_k = sum w_f s_f e_kf, less the mean times the transform of the window, with
    the frame counts known first: (capture_id, frames), where they can be had for
    less than running ra twice. A band has more bins the longer a capture is;
    where it has more than most, sums would be larger than the frames, and its
    capture goes through movement_map.
    """
    counts = counts if counts is not None else ra.groupBy("capture_id").agg((F.max("frame") + 1).cast("int").alias("frames"))  # a row for each capture

    def bins_of(frames: int) -> tuple[int, np.ndarray]:
        n = fft_size(frames)
        return n, np.flatnonzero(band_mask(np.fft.rfftfreq(n, 1 / fps), band))

    def sized(batches):
        for batch in batches:
            yield batch.assign(wide=[len(bins_of(n)[1]) > most for n in batch["frames"]])

    kind = counts.schema["capture_id"].dataType.simpleString()
    counts = materialise(counts.select("capture_id", F.col("frames").cast("int").alias("frames")).mapInPandas(sized, f"capture_id {kind}, frames int, wide boolean"))
    kinds = {r["wide"] for r in counts.select("wide").distinct().collect()}
    if False not in kinds and kinds:
        return movement_map(ra, band, fps, in_db, counts.drop("wide"))
    if True in kinds:
        ra = materialise(ra)

    def handed_on(sums: dict) -> pd.DataFrame:
        rows = [(cap, bin_, frames, b, x[b * BIN_BLOCK : (b + 1) * BIN_BLOCK].real.ravel(), x[b * BIN_BLOCK : (b + 1) * BIN_BLOCK].imag.ravel(), total) for (cap, bin_, frames), (x, total) in sums.items() for b in range(-(-len(x) // BIN_BLOCK))]
        return pd.DataFrame(rows, columns=["capture_id", "range_idx", "frames", "block", "re", "im", "total"])

    def partial(batches):
        sums: dict = {}
        bins: dict = {}
        held = 0
        for batch in batches:
            for cap, frame, bin_, body, frames in zip(batch["capture_id"], batch["frame"], batch["range_idx"], batch["db"], batch["frames"]):
                s = 10 ** (np.asarray(body) / 10) if in_db else np.asarray(body)
                if frames not in bins:
                    bins[frames] = bins_of(frames)
                n, ks = bins[frames]
                window = 0.5 - 0.5 * np.cos(2 * np.pi * frame / (frames - 1)) if frames > 1 else 1.0
                turn = window * np.exp(-2j * np.pi * (ks * frame % n) / n)
                if (cap, bin_, frames) not in sums:
                    sums[cap, bin_, frames] = [np.zeros((len(ks), len(s)), complex), np.zeros(len(s))]
                    held += 16 * len(ks) * len(s)
                x, total = sums[cap, bin_, frames]
                x += turn[:, None] * s
                total += s
                if held > HELD:
                    yield handed_on(sums)
                    sums, held = {}, 0
        yield handed_on(sums)

    keys = ["capture_id", "range_idx", "frames", "block"]
    known = join_small(ra, counts, "capture_id")
    rows = known.where("not wide").select("capture_id", "frame", "range_idx", "db", "frames").mapInPandas(partial, "capture_id string, range_idx int, frames int, block int, re array<double>, im array<double>, total array<double>")

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        frames, total = int(key[2]), rows["total"].sum()
        n, ks = bins_of(frames)
        ks = ks[key[3] * BIN_BLOCK : (key[3] + 1) * BIN_BLOCK]
        x = (rows["re"].sum() + 1j * rows["im"].sum()).reshape(len(ks), -1)
        energy = np.abs(x - longseries.hann_transform(ks, frames, n)[:, None] * (total / frames)).sum(axis=0)
        return pd.DataFrame({"capture_id": key[0], "range_idx": np.int32(key[1]), "angle_idx": np.arange(len(energy), dtype=np.int32), "e": energy})

    blocks = rows.groupBy(*keys).applyInPandas(finish, "capture_id string, range_idx int, angle_idx int, e double")
    narrow = _relative(blocks.groupBy("capture_id", "range_idx", "angle_idx").agg(F.sum("e").alias("e")))
    if True not in kinds:
        return narrow
    return narrow.unionByName(movement_map(known.where("wide").drop("wide", "frames"), band, fps, in_db, counts.where("wide").drop("wide")))


def source_signal(profile: DataFrame, bin_: int | None = None, around: int = 0) -> DataFrame:
    """(capture_id, frame, signal) of mean-Doppler profiles: at a bin, over bins near it, or over all bins."""
    rows = profile if bin_ is None else profile.where(F.col("range_idx").between(max(0, bin_ - around), bin_ + around))
    return rows.groupBy("capture_id", "frame").agg(F.avg("mag").alias("signal"))


def profile_signal(profiles: DataFrame, bin_: int | None = None, around: int = 0) -> DataFrame:
    """source_signal of profiles that have one array mag for each frame, and their other columns; frames without such a bin have no row."""
    first = 0 if bin_ is None else max(0, bin_ - around)
    at = F.col("mag") if bin_ is None else F.slice("mag", first + 1, max(0, bin_ + around - first + 1))
    mean = F.when(F.size(at) > 0, F.aggregate(at, F.lit(0.0), lambda s, v: s + v) / F.size(at))
    return profiles.select(*[c for c in profiles.columns if c != "mag"], mean.alias("signal")).where("signal is not null")


def trailing(series: DataFrame, fps: float = FPS) -> DataFrame:
    """Each frame with the signals of the last max(16, round(5 fps)) frames up to it, oldest first."""
    w = max(16, round(5.0 * fps))
    line = Window.partitionBy("capture_id").orderBy("frame").rowsBetween(-(w - 1), 0)
    return series.withColumn("signals", F.collect_list("signal").over(line))


VITALS = "noise_pct double, breathing_pct double, hr_pct double, movement_pct double, br_hz double, br_bpm double, hr_hz double, hr_bpm double"


def vitals_of(x: np.ndarray, fps: float) -> tuple:
    """Shares of the bands in percent, and the strongest breathing and heart rates, of a signal of 4 frames or more."""
    n = fft_size(len(x))
    amplitude = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)), n=n))
    hz = np.fft.rfftfreq(n, 1 / fps)
    total = amplitude.sum() + 1e-12
    shares = [100 * amplitude[band_mask(hz, b)].sum() / total for b in ("noise", "breathing", "hr", "movement")]
    rates = []
    for band in ("breathing", "hr"):
        at = np.flatnonzero(band_mask(hz, band))
        f = float(hz[at[amplitude[at].argmax()]]) if len(at) else 0.0
        rates += [f, 60 * f]
    return (*map(float, shares), *rates)


def vitals(series: DataFrame, fps: float | str = FPS, longest: int = LONGEST) -> DataFrame:
    """Vital signs of each capture from its whole signal; captures of fewer than 4 frames have none. fps: a number, or the name of a column of series.

    Captures of which the transform has at most longest points are one array
    each; longer ones are transformed in two steps, and their shares and rates
    put together from parts of the spectrum.
    """
    kind = series.schema["capture_id"].dataType.simpleString()
    rated = materialise(series.select("capture_id", "frame", F.col("signal").cast("double").alias("signal"), _rate(fps)))  # one double for each frame
    counts = rated.groupBy("capture_id").agg(F.count(F.lit(1)).cast("int").alias("frames")).where("frames >= 4").withColumn("long", _long(F.col("frames"), longest))
    kinds = {r["long"] for r in counts.select("long").distinct().collect()}
    known = join_small(rated, materialise(counts), "capture_id") if True in kinds else rated
    names = [c.split()[0] for c in VITALS.split(", ")]

    def rows(batches):
        for batch in batches:
            found = [(c, *vitals_of(np.asarray(x, float), f)) for c, f, x in zip(batch["capture_id"], batch["fps"], batch["x"])]
            yield pd.DataFrame(found, columns=["capture_id", *names])

    # ordered arrays are built in the aggregate, and the transform is a map over them
    whole = (known.where("not long") if True in kinds else known).groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("frame", "signal"))).alias("x"), F.max("fps").alias("fps")).where(F.size("x") >= 4).select("capture_id", "fps", F.col("x.signal").alias("x"))
    short = whole.mapInPandas(rows, f"capture_id {kind}, {VITALS}")
    if True not in kinds:
        return short

    def part(key: tuple, k: np.ndarray, found: np.ndarray, n: int, fps: float) -> tuple:
        step = 1.0 / (n * (1 / fps))
        hz, a = k * step, found[:, 0]
        row = [float(a[band_mask(hz, b, n // 2 * step)].sum()) for b in ("noise", "breathing", "hr", "movement")]
        tops = []
        for band in ("breathing", "hr"):
            at = np.flatnonzero(band_mask(hz, band, n // 2 * step))
            best = at[np.lexsort((k[at], -a[at]))[:1]]
            tops += [float(a[best[0]]), int(-k[best[0]])] if len(best) else [None, None]
        return (key[0], *row, float(a.sum()), *tops, step)

    cells = longseries.positions(known.where("long"), ["capture_id"], "frame", "__at").select("capture_id", F.lit(0).alias("cell"), F.col("__at").cast("int").alias("frame"), "frames", "fps", F.array("signal").alias("x"))
    parts = longseries.amplitudes(cells, part, f"capture_id {kind}, noise double, breathing double, hr double, movement double, all double, br_a double, br_k long, hr_a double, hr_k long, step double")
    sums = parts.groupBy("capture_id").agg(*[F.sum(c).alias(c) for c in ("noise", "breathing", "hr", "movement", "all")], *[F.max(F.when(F.col(f"{b}_a").isNotNull(), F.struct(f"{b}_a", f"{b}_k")))[f"{b}_k"].alias(f"{b}_top") for b in ("br", "hr")], F.max("step").alias("step"))
    share = lambda c: (100 * F.col(c) / (F.col("all") + 1e-12)).alias(f"{c}_pct")
    rate = lambda c, times: F.coalesce(-F.col(f"{c}_top") * F.col("step") * times, F.lit(0.0)).alias(f"{c}_{'hz' if times == 1 else 'bpm'}")
    long = sums.select("capture_id", share("noise"), share("breathing"), share("hr"), share("movement"), rate("br", 1), rate("br", 60), rate("hr", 1), rate("hr", 60))
    return long if False not in kinds else short.unionByName(long)


def band_energy_by_window(series: DataFrame, frames: int = 32, hop: int | None = None, band: str = "movement", fps: float = FPS) -> DataFrame:
    """(capture_id, window_idx, energy): spectral amplitude in a band of each whole window of frames."""
    hop = hop or frames
    kind = series.schema["capture_id"].dataType.simpleString()
    # a frame lies in the windows that start at most frames - 1 before it
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - (frames - 1)) / hop)).cast("int")
    spread = series.withColumn("window_idx", F.explode(F.sequence(first, F.expr(f"cast(frame div {hop} as int)")))) if hop < frames else series.withColumn("window_idx", F.expr(f"cast(frame div {hop} as int)")).where(F.col("frame") % hop < frames)
    whole = spread.groupBy("capture_id", "window_idx").agg(F.array_sort(F.collect_list(F.struct("frame", "signal"))).alias("x")).where(F.size("x") == frames)
    whole = whole.select("capture_id", "window_idx", F.col("x.signal").cast("array<double>").alias("x"))
    n = fft_size(frames)
    kept = band_mask(np.fft.rfftfreq(n, 1 / fps), band)

    def rows(batches):
        for batch in batches:
            energies = [np.empty(0)]
            # some windows at a time; their numbers never become Python's objects
            for at in range(0, batch.num_rows, step := max(1, WINDOWS // n)):
                x = batch.column("x").slice(at, step).flatten().to_numpy(zero_copy_only=False).reshape(-1, frames)
                a = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * np.hanning(frames), n=n, axis=1))
                energies.append(a[:, kept].sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("capture_id"), batch.column("window_idx"), pa.array(np.concatenate(energies), pa.float64())], names=["capture_id", "window_idx", "energy"])

    return whole.mapInArrow(rows, f"capture_id {kind}, window_idx int, energy double")


def phase_displacement(cells: DataFrame, wavelength: float | str, block: int = 4096) -> DataFrame:
    """(capture_id, rx, t, re, im) at one range bin -> displacement in metres: the phase, unwrapped by counting its jumps, times wavelength / 4 pi. wavelength: metres, or the name of a column of cells.

    Jumps are counted within blocks of t; a table with one row for each block
    adds the jumps of the blocks before and those between blocks, so no task
    orders a whole capture.
    """
    keys = ["capture_id", "rx", "__block"]
    turns = lambda step: F.when(step > math.pi, -1).when(step <= -math.pi, 1).otherwise(0)
    inside, line = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy("capture_id", "rx").orderBy("__block")
    metres = F.col(wavelength) if isinstance(wavelength, str) else F.lit(float(wavelength))
    rows = cells.select("capture_id", "rx", "t", metres.alias("__metres"), F.atan2("im", "re").alias("phase"), F.expr(f"t div {block}").alias("__block"))
    rows = rows.withColumn("__turn", turns(F.col("phase") - F.lag("phase").over(inside)))
    ends = rows.groupBy(*keys).agg(F.min_by("phase", "t").alias("first"), F.max_by("phase", "t").alias("last"), F.sum("__turn").alias("within"))
    ends = ends.withColumn("__edge", turns(F.col("first") - F.lag("last").over(line)))
    ends = ends.select(*keys, (F.sum(F.col("__edge") + F.col("within")).over(line) - F.col("within")).alias("__before"))
    unwrapped = F.col("phase") + 2 * math.pi * (F.col("__before") + F.sum("__turn").over(inside))
    return rows.join(ends, keys).select("capture_id", "rx", "t", (unwrapped * (F.col("__metres") / (4 * math.pi))).alias("displacement_m"))


def displacement_bands(displacement: DataFrame, fps: float | str = FPS, seconds: float = 8.0, block: int = longseries.FILTER_BLOCK) -> DataFrame:
    """(capture_id, rx, t, breathing_m, heart_m): the displacement through band-pass filters of the two bands, each of twice so many seconds."""
    found = [longseries.band_pass(displacement, *band, fps, seconds, ["capture_id", "rx"], "t", "displacement_m", block).withColumnRenamed("displacement_m", name) for band, name in ((BREATHING, "breathing_m"), (HEART, "heart_m"))]
    return found[0].join(found[1], ["capture_id", "rx", "t"])


def displacement_rates(displacement: DataFrame, fps: float | str = FPS, seconds: float = 8.0, block: int = longseries.FILTER_BLOCK, longest: int = LONGEST) -> DataFrame:
    """(capture_id, rx, br_hz, br_bpm, hr_hz, hr_bpm): the strongest frequency of each band in the spectrum of the displacement that its filter leaves."""
    kind = displacement.schema["capture_id"].dataType.simpleString()
    rates = displacement.groupBy("capture_id").agg(F.max(fps).alias("fps")) if isinstance(fps, str) else None  # a row for each capture

    def strongest(band: tuple[float, float], name: str) -> DataFrame:
        left = longseries.band_pass(displacement, *band, fps, seconds, ["capture_id", "rx"], "t", "displacement_m", block)
        left = left if rates is None else left.join(rates, "capture_id")
        named = left.select(F.struct("capture_id", "rx").alias("capture_id"), F.col("t").alias("frame"), F.col("displacement_m").alias("signal"), *([] if rates is None else ["fps"]))
        return vitals(named, "fps" if rates is not None else fps, longest).select("capture_id", f"{name}_hz", f"{name}_bpm")

    both = strongest(BREATHING, "br").join(strongest(HEART, "hr"), "capture_id")
    return both.select(F.col("capture_id.capture_id").cast(kind).alias("capture_id"), "capture_id.rx", "br_hz", "br_bpm", "hr_hz", "hr_bpm")
