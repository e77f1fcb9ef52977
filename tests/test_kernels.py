"""Closed forms and plain loops against the kernels and the Spark operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.functions import kernels, signal
from sweepframe.operators import angles, cube, design, detection, doppler, logconfig, ranges, temporal


def tone_cube(spark, bins, loops=8, rx=2, n=32, doppler_bin=0):
    rows = []
    for f, k in enumerate(bins):
        for c in range(loops):
            for r in range(rx):
                x = np.exp(2j * np.pi * (k * np.arange(n) / n + doppler_bin * c / loops))
                rows.append(("T", f, c, r, x.real.tolist(), x.imag.tolist()))
    return spark.createDataFrame(rows, "capture_id string, frame int, chirp int, rx int, re array<double>, im array<double>")


def test_a_tone_peaks_at_its_bin(spark):
    mags = ranges.with_magnitude(ranges.range_fft(tone_cube(spark, [3, 9]), 64))
    rows = ranges.frame_profile(mags).groupBy("frame").agg(F.max_by("range_idx", "mag").alias("k")).orderBy("frame").collect()
    assert [r.k for r in rows] == [6, 18]


def test_a_moving_tone_peaks_at_its_velocity(spark):
    rd = doppler.range_doppler(tone_cube(spark, [5], doppler_bin=2), [0], 1, 8, 32)
    top = ranges.cells(rd).orderBy(F.col("mag").desc()).first()
    assert (top.doppler_idx, top.range_idx) == (6, 5)


def test_a_constant_cube_has_no_doppler(spark):
    rd = doppler.range_doppler(tone_cube(spark, [5]), [0], 1, 8, 32)
    assert ranges.cells(rd).agg(F.max("mag")).first()[0] < 1e-9


def test_transmit_positions():
    assert doppler.transmit_positions([1, 2], 2) == [0]
    assert doppler.transmit_positions([5, 4, 2, 4], 4) == [2]
    assert doppler.transmit_positions([5, 3], 2) == [0]
    assert doppler.transmit_positions([0, 0], 2) == [0, 1]
    assert doppler.transmit_positions(None, 4) == [0, 2]


def test_cfar_against_loops():
    rng = np.random.default_rng(0)
    grid = rng.exponential(size=(14, 17))
    for guard, train in ((1, 1), (2, 2)):
        w = guard + train
        for method, mean in (("average", np.mean), ("ordered", np.median)):
            expected = np.zeros(grid.shape, bool)
            for r in range(w, 14 - w):
                for c in range(w, 17 - w):
                    ring = [grid[r + i, c + j] for i in range(-w, w + 1) for j in range(-w, w + 1) if max(abs(i), abs(j)) > guard]
                    expected[r, c] = grid[r, c] > 1.5 * mean(ring)
            assert (kernels.detect(grid, guard, train, 1.5, method) == expected).all()
    assert not kernels.detect(grid[:4, :4], 1, 1, 0.1).any()


def test_labels_in_raster_order():
    hits = np.array([[0, 1, 0, 1], [1, 0, 0, 1], [1, 1, 0, 0]], bool)
    assert kernels.label4(hits).tolist() == [[0, 1, 0, 2], [3, 0, 0, 2], [3, 3, 0, 0]]


def test_two_waves_are_told_apart():
    x, _ = angles.geometry(8, 4, "AWR1843")
    grid = np.arange(-90.0, 91.0)
    vectors = kernels.steering(x, np.sin(np.deg2rad(grid)))
    rng = np.random.default_rng(1)
    waves = kernels.steering(x, np.sin(np.deg2rad([-30.0, 30.0])))
    loops = rng.normal(size=(200, 2)) @ waves + 0.01 * (rng.normal(size=(200, 8)) + 1j * rng.normal(size=(200, 8)))
    p = kernels.bartlett(loops[None], vectors)[0]
    assert abs(grid[p[:90].argmax()] + 30) <= 2 and abs(grid[90 + p[90:].argmax()] - 30) <= 2
    # Capon, from the formula: 1 / (a R^-1 a^H)
    cov = loops.conj().T @ loops / 200
    cov = cov + np.eye(8) * (np.trace(cov).real * 0.01 + 1e-9)
    expected = [1 / (np.real(v @ np.linalg.inv(cov) @ v.conj()) + 1e-12) for v in vectors]
    assert np.allclose(kernels.capon(loops[None], vectors)[0], expected)
    few = loops[None, :3]
    assert np.allclose(kernels.capon(few, vectors)[0], np.abs(few[0] @ vectors.conj().T).mean(axis=0))


def test_geometry():
    for n, rx, name in ((12, 4, ""), (8, 4, "AWR1843"), (4, 4, ""), (4, 2, "x")):
        x, y = angles.geometry(n, rx, name)
        assert len(x) == n and abs(x.mean()) < 1e-12 and abs(y.mean()) < 1e-12
    x, y = angles.geometry(12, 4)
    assert sorted(set(np.round(y - y.min(), 6))) == [0, 0.5, 1, 1.5]
    x, y = angles.geometry(12, 4, "", ([float(i) for i in range(12)], []))
    assert x.tolist() == list(range(12)) and not y.any()


def test_calibration():
    assert angles.calibration(2) is None
    f = angles.calibration(2, [0.5, 0.0, 2.0, 3.0, 0.0])
    assert np.allclose(f, [1, 1j])
    assert np.allclose(angles.calibration(2, [0.5, 0.0, 2.0, 0.0, 0.0], None), [1, 0])
    assert np.allclose(angles.calibration(2, None, [0.0, np.pi / 2]), [1, 1j])


def test_antenna_order_finds_swapped_receivers(spark):
    x, _ = angles.geometry(4, 4)
    wave = kernels.steering(x, np.sin(np.deg2rad([25.0])))[0]
    swapped = wave[[1, 0, 2, 3]]
    rows = [("C", f, l, a, [float(swapped[a].real)] * 2, [float(swapped[a].imag)] * 2) for f in range(2) for l in range(3) for a in range(4)]
    snapshots = spark.createDataFrame(rows, "capture_id string, frame int, loop int, ant int, re array<double>, im array<double>")
    found = angles.antenna_order(snapshots, x, 1)
    fixed = angles.apply_order(snapshots, found)
    spectrum = angles.spectrum_at(fixed, 1, x, list(range(-90, 91)), remove_static=False)
    best = spectrum.where("frame = 1").orderBy(F.col("db").desc()).first()
    assert abs(abs(best.angle_deg) - 25) <= 2


@pytest.mark.parametrize("fps", [15.0, 20.0])
def test_known_rates(fps):
    t = np.arange(300) / fps
    shares = temporal.vitals_of(np.sin(2 * np.pi * 0.25 * t) + 0.5 * np.sin(2 * np.pi * 1.2 * t), fps)
    assert abs(shares[5] - 15) < 3 and abs(shares[7] - 72) < 3 and sum(shares[:4]) > 99


def test_bands_share_the_edge(spark):
    hz = spark.createDataFrame([(0.05,), (0.6,), (0.7,), (1.0,), (5.0,)], "hz double")
    rows = [[b for b in ("noise", "breathing", "hr", "movement") if hz.where(F.col("hz") == v).select(temporal.in_band(F.col("hz"), b, 7.5)).first()[0]] for v in (0.05, 0.6, 0.7, 1.0, 5.0)]
    assert rows == [["noise"], ["breathing", "movement"], ["movement"], ["hr"], ["movement"]]


@pytest.mark.parametrize("lanes", [1, 2, 4])
@pytest.mark.parametrize("interleaved", [True, False])
@pytest.mark.parametrize("real", [True, False])
def test_words_round_trip(spark, lanes, interleaved, real):
    rng = np.random.default_rng(lanes)
    shape = (2, 2, lanes, 4)  # frames, chirps, receivers, samples
    i, q = rng.integers(-99, 99, shape), rng.integers(-99, 99, shape)
    order = (lambda a: np.swapaxes(a, 2, 3)) if interleaved else (lambda a: a)
    si, sq = order(i).ravel(), order(q).ravel()
    words = si if real else np.concatenate([np.stack([si.reshape(-1, lanes), sq.reshape(-1, lanes)], 1).ravel()])
    df = spark.createDataFrame([("c", k, int(v)) for k, v in enumerate([*words, 7])], "capture_id string, word_idx long, v smallint")
    rows = cube.address(cube.demux(df, lanes, real), 4, lanes, 2, interleaved).collect()
    assert len(rows) == i.size
    for r in rows:
        at = (r.frame, r.chirp, r.rx, r.n)
        assert r.i == i[at] and (r.q is None if real else r.q == q[at])
    size = len(words) // 2
    frames = spark.createDataFrame([("c", f, [int(v) for v in words[f * size : (f + 1) * size]]) for f in range(2)] + [("c", 2, [7])], "capture_id string, frame long, words array<smallint>")
    whole = cube.decode_frames(frames, lanes, 4, lanes, 2, interleaved, real).collect()
    assert len(whole) == 2 * 2 * lanes
    for r in whole:
        at = (r.frame, r.chirp, r.rx)
        assert r.re == i[at].tolist() and (r.im is None if real else r.im == q[at].tolist())


def test_lane_counts_that_cannot_be_decoded(spark):
    with pytest.raises(ValueError):
        cube.demux(spark.createDataFrame([], "capture_id string, word_idx long, v smallint"), 3)


def test_next_pow2(spark):
    n = [0, 1, 2, 3, 8, 9, 1 << 29, (1 << 29) + 1]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select(signal.next_pow2(F.col("n"))).collect()
    assert [r[0] for r in rows] == [None, 1, 2, 4, 8, 16, 1 << 29, 1 << 30]


def test_log_corner_cases(spark):
    lines = ["API:ProfileConfig,0,1491308088,1000,600,4000,0,0,1657,0,256,5000", "API:AdcOutConfig,0,9,0", "API:LaneConfig,7,", "API:FrameConfig,0,3,1,4,8000000,0,0,0", "noise", "API:ChirpConfig,0,1,0,0,0,0,0,5,0", "API:ChirpConfig,2,2,0,0,0,0,0,0,", "API:ProfileConfig,x"]
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(lines)], "capture_id string, line_no int, line string")
    r = logconfig.captures(df).first()
    assert (r.chip, r.band, r.adc_fmt, r.adc_bits, r.num_lanes, r.frame_unique, r.frames) == (None, "77" if 74 <= r.start_freq_ghz <= 82 else r.band, "UNK(9)", 12, 3, None, 1)
    assert r.tx_masks == [5, 5, 0] and r.active_tx == ["TX0,TX2"] and r.unique_chirps == 3 and r.positions_by_mask == {5: [0, 1]} and r.iq_order is None
    assert logconfig.captures(df.where("line_no > 0")).count() == 0


def test_chip_bands_and_words_of_formats(spark):
    names = ["AWR1642", "iwr18xx", "AWR1443", "IWR6843AOP", "xwr68xx", "AWR2188", "AWR1600", None]
    found = spark.createDataFrame([(n,) for n in names], "chip string").select(logconfig.chip_band(F.col("chip"))).collect()
    assert [r[0] for r in found] == ["77", "77", "77", "60", "60", None, None, None]
    formats = {"API:AdcOutConfig,2,0,1": 1, "API:AdcOutConfig,2,1,1": 2, "API:AdcOutConfig,2,2,1": 2, "API:AdcOutConfig,2,3,1": 1, "API:AdcOutConfig,2,9,1": 1, "none": 2}
    lines = [(str(k), n, t) for k, out in enumerate(formats) for n, t in enumerate(["API:ProfileConfig,0,1435388860,1000,600,4000,0,0,1657,0,256,5000", "API:FrameConfig,0,0,1,16,8000000,0,5,0", out])]
    rows = logconfig.captures(spark.createDataFrame(lines, "capture_id string, line_no int, line string")).collect()
    assert {int(r.capture_id): r.words_per_frame for r in rows} == {k: 2 * 16 * 256 * words for k, words in enumerate(formats.values())}


def test_presets(spark):
    rows = {r.goal_id: r for r in design.parameters(design.presets(spark)).collect()}
    assert rows["long_range"].reason is None and rows["long_range"].chirps >= 16 and rows["respiration"].reason == "bandwidth"


def test_snr(spark):
    row = spark.createDataFrame([(10.0, 1.0, 0.0)], "m double, n double, z double").select(detection.snr_db(F.col("m"), F.col("n")), detection.snr_db(F.col("m"), F.col("z"))).first()
    assert row[0] == 20 and row[1] == 0


def test_percentiles_of_each_capture(spark, monkeypatch):
    from sweepframe.functions import percentiles

    monkeypatch.setattr(percentiles, "ACCURACY", 1000)
    rng = np.random.default_rng(7)
    values = {"a": rng.exponential(size=30_000), "b": np.round(rng.normal(size=5_000), 1), "c": np.array([2.0]), "d": np.concatenate([np.zeros(9_000), rng.normal(size=20)])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)], "capture_id string, v double")
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    found = {r.capture_id: r.p for r in percentiles.percentiles(rows.repartition(7), F.col("v"), shares).collect()}
    assert set(found) == set(values)
    for k, v in values.items():
        assert np.allclose(found[k], np.quantile(v, shares), rtol=1e-12, atol=1e-12)


def test_phases_are_unwrapped_over_blocks(spark):
    rng = np.random.default_rng(3)
    phase = np.cumsum(rng.uniform(-2.5, 2.5, 200))
    rows = spark.createDataFrame([("c", 0, t, float(np.cos(x)), float(np.sin(x))) for t, x in enumerate(phase)] + [("d", 0, 5, 1.0, 0.0)], "capture_id string, rx int, t long, re double, im double")
    found = temporal.phase_displacement(rows, 4 * np.pi, block=16).orderBy("capture_id", "t").collect()
    assert np.allclose([r.displacement_m for r in found[:200]], phase - phase[0] + np.angle(np.exp(1j * phase[0]))) and found[200].displacement_m == 0.0


def test_both_movement_maps_agree_for_several_captures(spark):
    rng = np.random.default_rng(5)
    rows = [(c, f, r, rng.uniform(-30, 0, 37).tolist()) for c, n in (("a", 40), ("b", 23)) for f in range(n) for r in range(3)]
    ra = spark.createDataFrame(rows, "capture_id string, frame int, range_idx int, db array<double>")
    maps = [{(r.capture_id, r.range_idx, r.angle_idx): r.db for r in m(ra).collect()} for m in (temporal.movement_map, temporal.movement_map_by_sums)]
    assert maps[0].keys() == maps[1].keys() and len(maps[0]) == 2 * 3 * 37
    assert all(abs(maps[0][k] - maps[1][k]) < 1e-6 for k in maps[0]) and {k[0] for k, v in maps[0].items() if v == 0} == {"a", "b"}


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_ordered_cfar_at_any_quantile(share):
    """Ties, negative values and factors, rings of even and odd numbers of cells."""
    rng = np.random.default_rng(7)
    for grid in (rng.exponential(size=(20, 24)), rng.integers(0, 4, (20, 24)).astype(float), rng.normal(size=(20, 24)), np.ones((20, 24))):
        for guard, train, factor in ((1, 1, 1.5), (2, 3, 1.0), (0, 2, 0.7), (1, 2, -1.0)):
            w, ring = guard + train, kernels._ring(guard, train)
            expected = np.zeros(grid.shape, bool)
            for r in range(w, 20 - w):
                for c in range(w, 24 - w):
                    expected[r, c] = grid[r, c] > factor * np.quantile(grid[r - w : r + w + 1, c - w : c + w + 1][ring], share)
            assert (kernels.detect(grid, guard, train, factor, "ordered", share) == expected).all()


def test_labels_against_a_flood():
    rng = np.random.default_rng(8)
    spiral = np.zeros((41, 41), bool)
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = spiral[k + 2 : 41 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    shapes = [rng.random((30, 37)) < p for p in (0.1, 0.4, 0.6, 0.9)] + [np.zeros((4, 5), bool), np.ones((4, 5), bool), spiral, np.ones((1, 7), bool), np.eye(9, dtype=bool), np.zeros((0, 3), bool)]
    for hits in shapes:
        expected, n = np.zeros(hits.shape, int), 0
        for start in map(tuple, np.argwhere(hits)):
            if not expected[start]:
                n += 1
                stack = [start]
                while stack:
                    r, c = stack.pop()
                    if 0 <= r < hits.shape[0] and 0 <= c < hits.shape[1] and hits[r, c] and not expected[r, c]:
                        expected[r, c] = n
                        stack += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        assert (kernels.label4(hits) == expected).all()


@pytest.mark.parametrize("block", [3, 10, 1 << 16])
def test_line_cfar_by_blocks(spark, block):
    rng = np.random.default_rng(9)
    series = {"a": rng.exponential(size=57), "b": rng.exponential(size=9), "c": rng.exponential(size=10_000)}
    rows = [(c, 5 * t - 20, float(v)) for c, x in series.items() for t, v in enumerate(x)]
    got = {(r.capture_id, r.t): (r.noise, r.hit) for r in detection.cfar_line(spark.createDataFrame(rows, "capture_id string, t int, v double"), ["capture_id"], "t", "v", 1, 3, 1.5, block=block).collect()}
    expected = {}
    for c, x in series.items():
        for t in range(4, len(x) - 4):
            noise = np.concatenate([x[t - 4 : t - 1], x[t + 2 : t + 5]]).mean()
            expected[c, 5 * t - 20] = (noise, x[t] > 1.5 * noise)
    assert got.keys() == expected.keys() and all(abs(got[k][0] - expected[k][0]) < 1e-9 and got[k][1] == expected[k][1] for k in got)


def test_cells_by_the_range_step_of_a_column(spark):
    cells = spark.createDataFrame([(c, 0, r, float(a), -float(r), s) for c, s in (("a", 0.1), ("b", 0.5)) for r in range(5) for a in (-90, 0, 30)], "capture_id string, frame int, range_idx int, angle_deg double, db double, step double")
    found = angles.crop(angles.cartesian(cells, "step"), "step", 0.3).collect()
    assert {(r.capture_id, r.range_idx) for r in found} == {("a", 3), ("a", 4), ("b", 1), ("b", 2), ("b", 3), ("b", 4)}
    assert all(abs(r.x_m - r.range_idx * r.step * np.sin(np.deg2rad(r.angle_deg))) < 1e-12 and abs(r.y_m - r.range_idx * r.step * np.cos(np.deg2rad(r.angle_deg))) < 1e-12 for r in found)
