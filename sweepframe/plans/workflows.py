"""The three workloads, over all frames of all captures at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.signal import C0, bin_width_m, velocity_step
from sweepframe.operators import angles, detection, doppler, ranges, temporal


def chirp_interval(radar: dict) -> float:
    return radar["idle_s"] + radar["ramp_s"]


def targets(cube: DataFrame, radar: dict, chirps: int, n_fft: int = 256, guard: int = 2, train: int = 8, factor: float = 3.0, method: str = "average") -> DataFrame:
    """Cube -> targets (capture_id, frame, label, doppler_idx, range_idx, magnitude, range_m, velocity_ms).

    One shuffle of range spectra by (capture, frame); detection and labels run
    inside the same groups, and only detected cells leave them.
    """
    masks = radar["tx_masks"]
    places, stride = doppler.transmit_positions(masks, len(masks)), len(masks)
    loops = chirps // stride
    hits = doppler.range_doppler(cube, places, stride, chirps, n_fft, then=detection.Detect(guard, train, factor, method))
    step_v = velocity_step(loops, chirp_interval(radar) * stride, radar["start_hz"])
    return detection.to_targets(detection.peaks(hits), n_fft, bin_width_m(n_fft, radar["rate"], radar["slope"]), loops, step_v)


def range_azimuth(cube: DataFrame, radar: dict, n_rx: int, n_fft: int = 256, method: str = "bartlett", remove_static: bool = True, shift: bool = True) -> DataFrame:
    """Cube -> half-spectrum range-azimuth maps in dB."""
    stride = len(radar["tx_masks"])
    snapshots = angles.virtual_array(ranges.range_fft(cube, n_fft, full=False), stride, n_rx)
    x, _ = angles.geometry(stride * n_rx, n_rx)
    return angles.range_azimuth(snapshots, x, np.arange(-90.0, 91.0), method, remove_static, shift)


def frame_counts(cube: DataFrame) -> DataFrame:
    """(capture_id, frames), from the key columns alone."""
    return cube.groupBy("capture_id").agg((F.max("frame") + 1).cast("int").alias("frames"))


def movement(cube: DataFrame, radar: dict, n_rx: int, n_fft: int = 256, band: str = "movement", fps: float = temporal.FPS, by_sums: bool = False, longest: int = temporal.LONGEST) -> DataFrame:
    """Cube -> movement map of each capture; by_sums for bands of few bins."""
    ra = range_azimuth(cube, radar, n_rx, n_fft)
    if by_sums:
        return temporal.movement_map_by_sums(ra, band, fps, counts=frame_counts(cube))
    return temporal.movement_map(ra, band, fps, counts=frame_counts(cube), longest=longest)


def movement_by_window(cube: DataFrame, radar: dict, n_rx: int, n_fft: int = 256, frames: int = 32, hop: int | None = None, band: str = "movement", fps: float = temporal.FPS) -> DataFrame:
    """Cube -> movement map of each window of frames."""
    return temporal.movement_by_window(range_azimuth(cube, radar, n_rx, n_fft), frames, hop, band, fps)


def range_time(cube: DataFrame, chirps: int, n_fft: int = 256, real: bool = False) -> DataFrame:
    """Cube -> notched range-time map."""
    mags = ranges.with_magnitude(ranges.range_fft(cube, n_fft, real=real), real)
    return ranges.notch(ranges.range_time(mags, chirps), n_fft // 2 + 1 if real else n_fft)


def vital_signs(cube: DataFrame, radar: dict, chirps: int, n_fft: int = 256, bin_: int | None = None, around: int = 0, fps: float = temporal.FPS) -> DataFrame:
    """Cube -> vital signs of each capture, from the mean-Doppler profile."""
    masks = radar["tx_masks"]
    profiles = doppler.range_doppler(cube, doppler.transmit_positions(masks, len(masks)), len(masks), chirps, n_fft, then=doppler.MeanProfile())
    return temporal.vitals(temporal.profile_signal(profiles, bin_, around), fps)


def wavelength(radar: dict) -> float:
    return C0 / radar["start_hz"]
