"""Transforms in steps, filters by blocks and sliding windows against whole series in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.operators import longseries, temporal


@pytest.mark.parametrize("frames", [2, 3, 15, 33, 64, 100])
def test_transform_of_a_window(frames):
    n = longseries.fft_size(frames)
    k = np.arange(n)
    assert np.allclose(longseries.hann_transform(k, frames, n), np.fft.fft(np.hanning(frames), n), atol=1e-10)
    k = (frames - 1) * np.arange(3)  # frequencies on which a neighbour of the window falls
    assert np.allclose(longseries.hann_transform(k, frames, (frames - 1) * 4), [np.sum(np.hanning(frames) * np.exp(-2j * np.pi * x * np.arange(frames) / ((frames - 1) * 4))) for x in k], atol=1e-9)


@pytest.mark.parametrize("block", [1, 40, 1 << 16])
def test_amplitudes_of_all_frequencies(spark, block):
    rng = np.random.default_rng(2)
    series = {("a", 0): rng.normal(size=(150, 3)), ("a", 1): rng.normal(size=(150, 3)) + 5, ("b", 0): rng.normal(size=(5, 3))}
    rows = [(c, cell, f, len(x), 15.0, v.tolist()) for (c, cell), x in series.items() for f, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "capture_id string, cell int, frame int, frames int, fps double, x array<double>")

    def every(key, k, found, n, fps):
        import pandas as pd

        return pd.DataFrame({"capture_id": key[0], "cell": key[1], "k": k, "a": list(found), "n": n})

    got = longseries.amplitudes(frame, every, "capture_id string, cell int, k int, a array<double>, n int", block).collect()
    for (c, cell), x in series.items():
        own = sorted((r for r in got if (r.capture_id, r.cell) == (c, cell)), key=lambda r: r.k)
        n = longseries.fft_size(len(x))
        expected = np.abs(np.fft.rfft((x - x.mean(axis=0)) * np.hanning(len(x))[:, None], n, axis=0))
        assert [r.k for r in own] == list(range(n // 2 + 1)) and np.allclose([r.a for r in own], expected, atol=1e-9)


def test_vitals_of_long_and_short_captures(spark):
    rng = np.random.default_rng(3)
    rows = [(c, f, float(np.sin(2 * np.pi * 0.3 * f / 15) + 0.5 * np.sin(2 * np.pi * 1.3 * f / 15) + 0.1 * rng.normal() + 9)) for c, n in (("a", 700), ("b", 3), ("c", 40), ("d", 1030), ("e", 4)) for f in range(n)]
    series = spark.createDataFrame(rows, "capture_id string, frame int, signal double")
    gaps = series.withColumn("frame", F.col("frame") * 3 + 1000)  # places count, not numbers
    whole = {r.capture_id: r for r in temporal.vitals(series).collect()}
    assert set(whole) == {"a", "c", "d", "e"}
    for found in (temporal.vitals(series, longest=32), temporal.vitals(gaps, longest=512), temporal.vitals(series.withColumn("rate", F.lit(15.0)), "rate", longest=16)):
        got = {r.capture_id: r for r in found.collect()}
        assert set(got) == set(whole)
        assert all(np.allclose(list(got[c])[1:], list(whole[c])[1:], atol=1e-7) for c in whole)
    assert temporal.vitals(series.where("false"), longest=16).count() == 0


def maps(spark, frames):
    rng = np.random.default_rng(4)
    rows = [(c, f, r, (10 * np.log10(rng.exponential(size=20))).tolist()) for c, n in frames.items() for f in range(n) for r in range(2)]
    return spark.createDataFrame(rows, "capture_id string, frame int, range_idx int, db array<double>")


def test_movement_maps_in_steps(spark):
    ra = maps(spark, {"a": 130, "b": 20, "c": 64})
    key = lambda r: (r.capture_id, r.range_idx, r.angle_idx)
    whole = {key(r): r.db for r in temporal.movement_map(ra).collect()}
    assert len(whole) == 3 * 2 * 20
    for longest, counts in ((16, None), (32, ra.groupBy("capture_id").agg((F.max("frame") + 1).alias("frames"))), (64, None)):
        got = {key(r): r.db for r in temporal.movement_map(ra, counts=counts, longest=longest).collect()}
        assert set(got) == set(whole) and np.allclose([got[k] for k in whole], list(whole.values()), atol=1e-8)
    assert temporal.movement_map(ra.where("false"), longest=16).count() == 0


def test_no_group_of_a_long_capture_holds_all_frames(spark):
    """The groups of both steps, as Spark deals them."""
    ra = maps(spark, {"a": 4000}).where("range_idx = 0")
    counts = ra.groupBy("capture_id").agg((F.max("frame") + 1).alias("frames"))
    plan = temporal.movement_map(ra, counts=counts, longest=32)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("FlatMapGroupsInPandas") == 2 and "cblock" in plan
    r, c = longseries._sides(longseries.fft_size(4000))
    assert (r, c) == (64, 64)


@pytest.mark.parametrize("frames,hop,block", [(32, None, 256), (8, 3, 16), (8, 1, 5), (5, 9, 20), (40, 7, 3), (1, 1, 4)])
def test_movement_of_every_window(spark, frames, hop, block):
    ra = maps(spark, {"a": 70, "b": 33}).where("not (capture_id = 'b' and frame = 20)")
    got = {(r.capture_id, r.window_idx, r.range_idx, r.angle_idx): r.db for r in temporal.movement_by_window(ra, frames, hop, block=block).collect()}
    step, expected = hop or frames, {}
    cells = {(r.capture_id, r.range_idx, r.frame): np.array(r.db) for r in ra.collect()}
    for c, n in (("a", 70), ("b", 33)):
        for w in range(n // step + 1):
            if all((c, 0, f) in cells for f in range(w * step, w * step + frames)):
                x = np.stack([[10 ** (cells[c, r, w * step + f] / 10) for f in range(frames)] for r in range(2)])
                a = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * np.hanning(frames)[:, None], longseries.fft_size(frames), axis=1))
                e = a[:, temporal.band_mask(np.fft.rfftfreq(longseries.fft_size(frames), 1 / 15), "movement")].sum(axis=1)
                db = 10 * np.log10(e + 1e-12)
                expected |= {(c, w, r, k): db[r, k] - db.max() for r in range(2) for k in range(20)}
    assert set(got) == set(expected) and len(got) > 40
    assert np.allclose([got[k] for k in expected], list(expected.values()), atol=1e-6)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_band_pass_equals_a_filter_over_the_whole_series(spark, block):
    rng = np.random.default_rng(5)
    series = {("a", 15.0): rng.normal(size=200).cumsum(), ("b", 20.0): rng.normal(size=50).cumsum(), ("c", 5.0): np.array([3.0])}
    rows = [(c, fps, t, float(v), "x") for (c, fps), x in series.items() for t, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, ("a", 15.0, 9, None, "x")], "capture_id string, fps double, t long, value double, __own string")
    got = {(r.capture_id, r.t): r.value for r in longseries.band_pass(frame, 0.8, 3.5, "fps", 1.5, block=block).collect()}
    assert len(got) == 251
    for (c, fps), x in series.items():
        h = longseries.taps(0.8, 3.5, fps, 1.5)
        half = len(h) // 2
        whole = np.convolve(np.pad(x, half, mode="edge"), h, "valid")
        assert half == round(1.5 * fps) and np.allclose([got[c, t] for t in range(len(x))], whole, atol=1e-9)
    assert longseries.band_pass(frame.where("false"), 0.1, 0.6, 15.0).count() == 0


def test_band_pass_lets_its_band_through():
    fps, t = 15.0, np.arange(2000)
    h = longseries.taps(0.1, 0.6, fps, 8.0)
    level = lambda hz: np.convolve(np.cos(2 * np.pi * hz * t / fps), h, "valid")[500:-500].max()
    assert abs(level(0.3) - 1) < 0.02 and level(1.5) < 0.01 and abs(level(0.0)) < 0.02


def test_displacement_rates(spark):
    fps = {"a": 15.0, "b": 20.0}
    rows = [(c, rx, t, rate, float(0.005 * np.sin(2 * np.pi * 0.25 * t / rate) + 0.0005 * np.sin(2 * np.pi * 1.2 * t / rate) + 0.01)) for c, rate in fps.items() for rx in range(2) for t in range(900)]
    moved = spark.createDataFrame(rows, "capture_id string, rx int, t long, fps double, displacement_m double")
    for longest in (temporal.LONGEST, 64):
        found = temporal.displacement_rates(moved, "fps", block=100, longest=longest).collect()
        assert {(r.capture_id, r.rx) for r in found} == {(c, rx) for c in fps for rx in range(2)}
        assert all(abs(r.br_hz - 0.25) < 0.02 and abs(r.hr_hz - 1.2) < 0.02 and abs(r.hr_bpm - 60 * r.hr_hz) < 1e-9 for r in found)
    bands = temporal.displacement_bands(moved, "fps", block=100).where("t between 300 and 600").agg(F.max("breathing_m"), F.max("heart_m")).first()
    assert abs(bands[0] - 0.005) < 2e-4 and abs(bands[1] - 0.0005) < 5e-5


def test_sums_of_narrow_bands_and_frames_of_wide_ones(spark, monkeypatch):
    """Captures whose band has more bins than the most go through the plain map; no task adds up their sums."""
    ra = maps(spark, {"a": 130, "b": 20, "c": 64})
    whole = {(r.capture_id, r.range_idx, r.angle_idx): r.db for r in temporal.movement_map(ra).collect()}
    calls = []
    monkeypatch.setattr(temporal, "movement_map", lambda rows, *how, plain=temporal.movement_map: calls.append(sorted(r.capture_id for r in rows.select("capture_id").distinct().collect())) or plain(rows, *how))
    for most, wide in ((0, ["a", "b", "c"]), (20, ["a"]), (1000, None)):
        got = {(r.capture_id, r.range_idx, r.angle_idx): r.db for r in temporal.movement_map_by_sums(ra, most=most).collect()}
        assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-9 for k in whole)
        assert calls == ([wide] if wide else [])
        calls.clear()


def test_energies_of_windows_without_objects(spark, monkeypatch):
    """Windows reach Python as arrays of numbers, and are transformed some at a time."""
    monkeypatch.setattr(temporal, "WINDOWS", 96)
    rng = np.random.default_rng(6)
    x = {c: rng.normal(size=n) for c, n in (("a", 210), ("b", 31), ("c", 75))}
    series = spark.createDataFrame([(c, f, float(v)) for c, v in x.items() for f, v in enumerate(v)], "capture_id string, frame int, signal double")
    mask = temporal.band_mask(np.fft.rfftfreq(32, 1 / 15), "movement")
    for hop in (32, 10, 40):
        found = temporal.band_energy_by_window(series, 32, hop)
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        got = {(r.capture_id, r.window_idx): r.energy for r in found.collect()}
        expected = {(c, s // hop): np.abs(np.fft.rfft((v[s : s + 32] - v[s : s + 32].mean()) * np.hanning(32)))[mask].sum() for c, v in x.items() for s in range(0, len(v) - 31, hop)}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in expected)


def test_amplitudes_of_many_small_series(spark):
    """A reducer gives one plain row; many series go to Python in one call."""
    rng = np.random.default_rng(9)
    x = {c: rng.normal(size=40 + c % 30) for c in range(120)}
    rows = spark.createDataFrame([(c, 0, f, len(v), 15.0, [float(a)]) for c, v in x.items() for f, a in enumerate(v)], "capture_id long, cell int, frame int, frames int, fps double, x array<double>")
    found = longseries.amplitudes(rows, lambda key, k, found, n, fps: (key[0], float(found.sum())), "capture_id long, e double")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.capture_id: r.e for r in found.collect()}
    assert got.keys() == x.keys()
    assert all(abs(got[c] - np.abs(np.fft.rfft((v - v.mean()) * np.hanning(len(v)), longseries.fft_size(len(v)))).sum()) < 1e-9 for c, v in x.items())
