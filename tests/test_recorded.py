"""Captures and logs from a folder to results, against the workloads with constant parameters."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.functions import kernels
from sweepframe.functions.signal import C0
from sweepframe.operators import angles, cube, doppler, logconfig, ranges, temporal
from sweepframe.plans import recorded, workflows
from sweepframe.sources import captures

#: name, receivers, samples, chirps of the pattern, frames in the file, frames declared, frame ticks
CAPTURES = [("a", 2, 16, 2, 6, 100, 8_000_000), ("b", 4, 8, 1, 40, 100, 10_000_000), ("c", 1, 32, 2, 9, 7, 20_000_000)]
LOOPS = 8


def log(rx, n, stride, declared, ticks, lanes):
    mask = {1: 1, 2: 3, 4: 15}[rx]
    pattern = [f"API:ChirpConfig,{i},{i},0,0,0,0,0,{1 << i},0," for i in range(stride)]
    return "\n".join(["API:select_chip_version,AWR1642", f"API:ProfileConfig,0,1435388860,1000,600,4000,0,0,1657,0,{n},5000,0,0,30,0,", *pattern, f"API:FrameConfig,0,0,{stride - 1},{LOOPS},{ticks},0,{declared},0,", f"API:DataFmtConfig,{mask},2,1,0,0,1,", "API:AdcOutConfig,2,1,1,", f"API:LaneConfig,{lanes},"])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    rng = np.random.default_rng(11)
    for name, rx, n, stride, frames, declared, ticks in CAPTURES:
        words = rng.integers(-2000, 2000, frames * LOOPS * stride * rx * n * 2 + 3).astype("<i2")  # three words too many
        (path / f"{name}_Raw_0.bin").write_bytes(words.tobytes())
        (path / f"{name}_LogFile.txt").write_text(log(rx, n, stride, declared, ticks, 3))
    (path / "alone.bin").write_bytes(b"\0" * 64)
    (path / "lanes.bin").write_bytes(b"\0" * 64)
    (path / "lanes_LogFile.txt").write_text(log(2, 16, 2, 1, 8_000_000, 7))
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return recorded.splits(recorded.files(spark, f"file://{folder}"))


def name_of(column="capture_id"):
    return F.regexp_extract(column, r"/(\w+?)(_Raw_0)?\.bin$", 1)


def constant_cube(spark, folder, which):
    name, rx, n, stride, frames, declared, _ = CAPTURES[which]
    size = LOOPS * stride * rx * n * 2
    words = np.fromfile(folder / f"{name}_Raw_0.bin", "<i2")
    data = [(name, f, words[f * size : (f + 1) * size].tolist()) for f in range(min(frames, declared))]
    raw = spark.createDataFrame(data, "capture_id string, frame long, words array<smallint>")
    return cube.decode_frames(raw, 2, n, rx, LOOPS * stride, True, bits=16)


def radar_of(s):
    return {"start_hz": s["start_hz"], "slope": s["slope"], "rate": s["rate"], "idle_s": s["idle_s"], "ramp_s": s["ramp_s"], "tx_masks": list(s["tx_masks"])}


def test_captures_that_cannot_be_decoded_are_named(spark, folder):
    found = recorded.files(spark, f"file://{folder}").select(name_of().alias("name"), "reason").collect()
    assert {r["name"]: r.reason for r in found} == {"a": None, "b": None, "c": None, "alone": "log", "lanes": "lanes"}


def test_targets_of_files(spark, folder, rows):
    found = {}
    for r in recorded.targets(rows, 32, 1, 1, 1.5).withColumn("name", name_of()).collect():
        found.setdefault(r["name"], set()).add((r.frame, r.label, r.doppler_idx, r.range_idx, round(r.magnitude, 6), round(r.range_m, 6), round(r.velocity_ms, 6)))
    known = {r["name"]: r for r in rows.withColumn("name", name_of()).collect()}
    for which, (name, _, _, stride, *_) in enumerate(CAPTURES):
        expected = workflows.targets(constant_cube(spark, folder, which), radar_of(known[name]), LOOPS * stride, 32, 1, 1, 1.5).collect()
        assert expected and found[name] == {(r.frame, r.label, r.doppler_idx, r.range_idx, round(r.magnitude, 6), round(r.range_m, 6), round(r.velocity_ms, 6)) for r in expected}


def test_a_capture_in_several_ranges(spark, folder, rows, monkeypatch):
    monkeypatch.setattr(captures, "SPLIT", 3 * 1024)
    split = recorded.splits(recorded.files(spark, f"file://{folder}"))
    assert split.count() > rows.count() and split.agg(F.sum("count")).first()[0] == 6 + 40 + 7
    key = lambda df: sorted(map(tuple, recorded.profiles(df, None).select("capture_id", "frame", "mag").collect()))
    assert key(split) == key(rows)


def test_movement_and_vital_signs_at_the_rate_of_the_log(spark, folder, rows):
    maps = recorded.movement(rows, 32).withColumn("name", name_of()).collect()
    vitals = {r["name"]: r for r in recorded.vital_signs(rows, 32, 4, 2).withColumn("name", name_of()).collect()}
    for which, (name, rx, _, stride, frames, declared, ticks) in enumerate(CAPTURES):
        fps, count = 1000 / (ticks * 5 / 1e6), min(frames, declared)
        radar = radar_of({r["name"]: r for r in rows.withColumn("name", name_of()).collect()}[name])
        whole = constant_cube(spark, folder, which)
        mode = {} if stride == 2 else radar | {"tx_masks": [1]}
        expected = {(r.range_idx, r.angle_idx): r.db for r in workflows.movement(whole, mode or radar, rx, 32, fps=fps).collect()}
        got = {(r.range_idx, r.angle_idx): r.db for r in maps if r["name"] == name}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-6 for k in got)
        signal = [r.mag for r in recorded.profiles(rows, 32).where(name_of() == name).orderBy("frame").collect()]
        assert len(signal) == count
        assert np.allclose(list(vitals[name])[1:9], temporal.vitals_of(np.array([np.mean(m[2:7]) for m in signal]), fps))


def test_range_time_of_files(spark, folder, rows):
    found = recorded.range_time(rows, None).withColumn("name", name_of()).collect()
    for which, (name, _, n, stride, *_) in enumerate(CAPTURES):
        expected = {(r.t, r.range_idx): r.mag for r in workflows.range_time(constant_cube(spark, folder, which), LOOPS * stride, n).collect()}
        got = {(r.t, r.range_idx): r.mag for r in found if r["name"] == name}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_no_captures(spark, rows):
    none = rows.where("false")
    assert recorded.targets(none).count() == recorded.movement(none).count() == recorded.vital_signs(none).count() == recorded.range_time(none).count() == 0


def test_rows_of_different_lengths_and_nulls(spark):
    rows = [("a", 0, 0, 0, [1.0, 2.0, 3.0, 4.0], [0.0] * 4), ("b", 0, 0, 0, [1.0, 5.0], [0.0] * 2), ("c", 0, 0, 0, None, None)]
    df = spark.createDataFrame(rows, "capture_id string, frame int, chirp int, rx int, re array<double>, im array<double>").coalesce(1)
    found = {r.capture_id: r.re and len(r.re) for r in ranges.range_fft(df).collect()}
    assert found == {"a": 4, "b": 2, "c": None}


def test_raw_words_are_not_shuffled(rows):
    plan = recorded.movement(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") + plan.count("PythonMapInArrow") == 1 and plan.count("FlatMapGroupsInPandas") == 1


def test_recordings_in_several_files(spark, folder, rows, tmp_path):
    """The same bytes in files that are cut anywhere, within words and frames, and shorter than a frame."""
    name, rx, n, stride, *_ = CAPTURES[0]
    body = (folder / f"{name}_Raw_0.bin").read_bytes()
    size = LOOPS * stride * rx * n * 2 * 2
    cuts = [0, size + 7, size + 9, 3 * size + 1, len(body)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"{name}_Raw_{k}.bin").write_bytes(body[a:b])
    (tmp_path / f"{name}_LogFile.txt").write_text((folder / f"{name}_LogFile.txt").read_text())
    (tmp_path / "gap_Raw_0.bin").write_bytes(body)
    (tmp_path / "gap_Raw_2.bin").write_bytes(body)
    (tmp_path / "gap_LogFile.txt").write_text((folder / f"{name}_LogFile.txt").read_text())
    found = recorded.files(spark, f"file://{tmp_path}")
    assert {r["n"]: (r.reason, r.length) for r in found.select(name_of().alias("n"), "reason", "length").collect()} == {"a": (None, len(body)), "gap": ("parts", 2 * len(body))}
    frames = lambda df: sorted((r.frame, *r.mag) for r in recorded.profiles(df, None).where(name_of() == "a").collect())
    assert frames(recorded.splits(found)) == frames(rows)
    one_each = recorded.splits(found).withColumn("first", F.explode(F.expr("sequence(first, first + count - 1)")))
    assert one_each.count() == 6


def test_ranges_of_split_recordings(spark, folder, rows, tmp_path, monkeypatch):
    name = CAPTURES[0][0]
    body = (folder / f"{name}_Raw_0.bin").read_bytes()
    for k, (a, b) in enumerate(((0, 5000), (5000, len(body)))):
        (tmp_path / f"{name}_Raw_{k}.bin").write_bytes(body[a:b])
    (tmp_path / f"{name}_LogFile.txt").write_text((folder / f"{name}_LogFile.txt").read_text())
    monkeypatch.setattr(captures, "SPLIT", 3 * 1024)
    split = recorded.splits(recorded.files(spark, f"file://{tmp_path}"))
    assert split.count() == 6 and sum(len(r.pieces) for r in split.collect()) == 7
    frames = lambda df: sorted((r.frame, *r.mag) for r in recorded.profiles(df, None).where(name_of() == "a").collect())
    assert frames(split) == frames(rows)


def plane_wave(places, angle, loops, bins_at, n, phase=0.0):
    """(chirps of one transmitter, receivers, samples): a target at a bin and angle whose phase turns from chirp to chirp."""
    tone = np.exp(2j * np.pi * bins_at * np.arange(n) / n)
    wave = np.exp(2j * np.pi * np.asarray(places) * np.sin(np.deg2rad(angle)))
    return np.exp(1j * (phase + 2.1 * np.arange(loops)))[:, None, None] * wave[None, :, None] * tone


def record(folder, name, x, *more):
    """Chirps x receivers x samples as a file of interleaved complex words on two lanes, and its log."""
    rx, n = x.shape[1:]
    flat = np.moveaxis(x, 2, 1).reshape(-1, 2)  # samples in file order, two lanes a group
    words = np.concatenate([flat.real, flat.imag], axis=1)
    (folder / f"{name}_Raw_0.bin").write_bytes(np.round(words * 8000).astype("<i2").tobytes())
    (folder / f"{name}_LogFile.txt").write_text("\n".join([log(rx, n, 1, 100, 8_000_000, 3), *more]))


def test_places_and_orders_of_antennas_in_the_log(spark, tmp_path):
    places = [0.0, 0.5, 1.0, 1.5]
    own = [0.0, 0.3, 1.0, 1.6]
    wave = lambda p, angle: plane_wave(p, angle, LOOPS, 5, 32)
    record(tmp_path, "plain", wave(places, 20))
    record(tmp_path, "placed", wave(own, -35), "API:antGeometry0," + ",".join(map(str, own)))
    record(tmp_path, "swapped", wave(places, 20)[:, [0, 2, 1, 3]])
    record(tmp_path, "turned", wave(places, 20) * np.exp(1j * np.array([0.0, 1.0, -0.5, 2.0]))[:, None], "API:antPhaseRot,0.0,1.0,-0.5,2.0")
    rows = recorded.splits(recorded.files(spark, f"file://{tmp_path}"))
    top = lambda df: {r["n"]: int(np.argmax(r.db)) - 90 for r in df.withColumn("n", name_of()).collect()}
    metres = 5 * C0 * (5e6 / 32) / (2 * 1657 * logconfig.SLOPE_LSB["77"] * 1e12)
    plain = recorded.angle_spectrum(rows, metres, None, remove_static=False)
    assert {r.range_idx for r in plain.collect()} == {5}
    found = top(plain)
    assert (found["plain"], found["placed"], found["turned"]) == (20, -35, 20) and found["swapped"] != 20
    orders = {r["n"]: r for r in recorded.antenna_orders(rows, None, metres=metres).withColumn("n", name_of()).collect()}
    vectors = kernels.steering(angles.geometry(4, 4, "AWR1642")[0], np.sin(np.deg2rad(np.arange(-90.0, 91.0))))
    for name, x in (("plain", wave(places, 20)), ("swapped", wave(places, 20)[:, [0, 2, 1, 3]])):
        z = np.moveaxis(kernels.spectrum(np.round(x * 8000) / 32767, 32, "hann", True, 32), 2, 0)
        tried = []
        for conjugated in (False, True):
            for order in itertools.permutations(range(4)):
                strongest = z[5][(np.abs(z[5]) ** 2).sum(axis=1).argmax()][list(order)]
                p = [abs(sum(v * (s.conj() if conjugated else s).conj() for v, s in zip(vector, strongest))) ** 2 for vector in vectors]
                tried.append((max(p) - np.median(p), list(order), conjugated))
        best = max(t[0] for t in tried)
        assert any(abs(t[0] - best) < 1e-9 * best and t[1] == orders[name].antennas and t[2] == orders[name].conjugated for t in tried)
    automatic = top(recorded.angle_spectrum(rows, metres, None, order="auto", remove_static=False))
    sharp = {r["n"]: float(np.median(r.db)) for r in recorded.angle_spectrum(rows, metres, None, order="auto", remove_static=False).withColumn("n", name_of()).collect()}
    assert abs(automatic["swapped"]) == abs(automatic["plain"]) and abs(sharp["swapped"] - sharp["plain"]) < 0.5
    assert recorded.range_azimuth(rows, None, order="auto").count() == 4 * 17
    assert recorded.antenna_orders(rows.where("false")).count() == 0


def test_azimuth_and_elevation_of_a_grid(spark, tmp_path):
    x, y = [-0.25, 0.25, -0.25, 0.25], [-0.25, -0.25, 0.25, 0.25]
    az, el = 30, -20
    phase = 2 * np.pi * (np.array(x) * np.sin(np.deg2rad(az)) * np.cos(np.deg2rad(el)) + np.array(y) * np.sin(np.deg2rad(el)))
    wave = np.exp(1j * phase)[None, :, None] * np.exp(2j * np.pi * 5 * np.arange(32) / 32) * np.ones((LOOPS, 1, 1))
    record(tmp_path, "grid", wave, "API:antGeometry0," + ",".join(map(str, x)), "API:antGeometry1," + ",".join(map(str, y)))
    rows = recorded.splits(recorded.files(spark, f"file://{tmp_path}"))
    grid = list(range(-90, 91, 10))
    found = recorded.azimuth_elevation(rows, grid, grid, 5 * C0 * (5e6 / 32) / (2 * 1657 * logconfig.SLOPE_LSB["77"] * 1e12), None, shift=False).collect()
    best = max(found, key=lambda r: max(r.db))
    assert len(found) == len(grid) and best.el_deg == el and grid[int(np.argmax(best.db))] == az and best.range_idx == 5


def test_displacement_of_recordings(spark, rows):
    found = recorded.displacement(rows, 3.0, None).withColumn("n", name_of()).collect()
    assert {(r["n"], r.rx) for r in found} == {(c[0], k) for c in CAPTURES for k in range(c[1])}
    assert {r["n"]: round(r.fps, 6) for r in found} == {c[0]: round(1000 / (c[6] * 5 / 1e6), 6) for c in CAPTURES}
    series = [r.displacement_m for r in sorted(found, key=lambda r: r.t) if r["n"] == "b" and r.rx == 0]
    assert len(series) == 40 and max(abs(np.diff(series))) <= C0 / 77e9 / 4 * 1.01
    assert recorded.displacement(rows.where("false")).count() == 0


def test_movement_of_windows_of_recordings(spark, rows):
    maps = recorded.range_azimuth(rows, 32)
    key = lambda df: {tuple(r)[:4]: r.db for r in df.collect()}
    got = key(recorded.movement_by_window(rows, 32, 6, 3))
    assert got == key(temporal.movement_by_window(maps, 6, 3, fps="fps"))
    assert {k[:2] for k in got if "/b_" in k[0]} == {(k[0], w) for k in got if "/b_" in k[0] for w in range(12)}


def test_profiles_background_and_micro_doppler_of_recordings(spark, folder, rows):
    dbfs = recorded.profile_dbfs(rows, None).withColumn("n", name_of()).collect()
    plain, moving = (recorded.frame_profiles(rows, None, alpha).withColumn("n", name_of()).collect() for alpha in (None, 0.5))
    micro = recorded.micro_doppler(rows, 1, 3, None).withColumn("n", name_of()).collect()
    known = {r["n"]: r for r in rows.withColumn("n", name_of()).collect()}
    for which, (name, _, n, stride, *_) in enumerate(CAPTURES):
        whole = constant_cube(spark, folder, which)
        close = lambda got, expected: got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
        assert close({(r.frame, r.rx, r.range_idx): r.dbfs for r in dbfs if r["n"] == name}, {(r.frame, r.rx, r.range_idx): r.dbfs for r in ranges.profile_dbfs(whole, n).collect()})
        profile = ranges.frame_profile(ranges.with_magnitude(ranges.range_fft(whole, n)))
        for got, expected in ((plain, profile), (moving, ranges.remove_background(profile, 0.5))):
            assert close({(r.frame, r.range_idx): r.mag for r in got if r["n"] == name}, {(r.frame, r.range_idx): r.mag for r in expected.collect()})
        masks = radar_of(known[name])["tx_masks"]
        rd = doppler.range_doppler(whole, doppler.transmit_positions(masks, stride), stride, LOOPS * stride, n)
        assert close({(r.frame, r.doppler_idx): r.db for r in micro if r["n"] == name}, {(r.frame, r.doppler_idx): r.db for r in doppler.micro_doppler(rd, 3, 1).collect()})


def test_chirps_of_a_transmitter():
    x = np.arange(12)[:, None, None] * np.ones((1, 2, 3))
    s = {"tx_masks": [1, 4, 3, 4], "stride": 4}
    assert recorded.of_transmitter(s, x, 2)[:, 0, 0].tolist() == [1, 3, 5, 7, 9, 11]
    assert recorded.of_transmitter(s, x, 0)[:, 0, 0].tolist() == [0, 4, 8]
    assert recorded.of_transmitter(s, x, 1) is x and recorded.of_transmitter(s, x, None) is x and recorded.of_transmitter({**s, "stride": 5}, x, 0) is x
    assert recorded.of_transmitter({"tx_masks": None, "stride": 1}, x, 0) is x


def test_the_transmitter_chosen_changes_the_maps(spark, rows):
    maps = [sorted((r["n"], r.frame, r.doppler_idx, *r.mag) for r in recorded.range_doppler(rows, None, transmitter=t).withColumn("n", name_of()).collect()) for t in (None, 0, 1)]
    of = lambda m, name: [x for x in m if x[0] == name]
    assert of(maps[0], "a") == of(maps[1], "a") != of(maps[2], "a") and len(of(maps[2], "a")) == len(of(maps[0], "a"))
    assert of(maps[0], "b") == of(maps[1], "b") == of(maps[2], "b")
