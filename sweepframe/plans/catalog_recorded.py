"""Registered queries of the workloads over recordings with settings of their own."""

from __future__ import annotations

import numpy as np

from sweepframe.functions.signal import C0
from sweepframe.operators import ranges, temporal
from sweepframe.operators.logconfig import SLOPE_LSB, START_GHZ
from sweepframe.plans import recorded
from sweepframe.plans.catalog import _AMPLITUDES, _SHARES, _longs, band_pass_sql, query, rounded
from sweepframe.sources import derived

PI2 = 2 * np.pi


def _row(k: int) -> str:
    """The settings of recording k as they follow from its log lines, written as a SQL row."""
    band, const = ("77", 1435388860) if k % 2 == 0 else ("60", 1491308088)
    samples, rx, real, stride = 16 if k < 3 else 8, 2 if k % 2 == 0 else 1, k == 2, 2 if k < 4 else 1
    bins, chirps = samples // 2 + 1 if real else samples, 8 * stride
    width = C0 * (5e6 / samples) / (2 * 1657 * SLOPE_LSB[band] * 1e12)
    step = C0 / (const / (1 << 26) * START_GHZ[band] * 1e9) / 2 / (8 * 50e-6 * stride)
    words = chirps * rx * samples * (1 if real else 2)
    return f"('{k}', {2 if k % 2 == 0 else 4}, {samples}, {rx}, {stride}, {words}, {k % 2 == 0}, {real}, {k == 3}, {5 if k == 4 else 100000000}, {bins}, {width!r}::DOUBLE, {step!r}::DOUBLE, {1000 / (40 + 5 * k)!r}::DOUBLE)"


_TURN = lambda a, b, n: (f"cos({PI2!r} * (({a} * {b}) % {n}) / {n})", f"sin({PI2!r} * (({a} * {b}) % {n}) / {n})")


def _dft(a: str, b: str, n: str) -> str:
    c, s = _TURN(a, b, n)
    return f"sum(re * {c} + im * {s}) AS re, sum(im * {c} - re * {s}) AS im"


_RD = f"""par(capture_id, lanes, ns, nrx, stride, fw, inter, isreal, swap, frames, bins, width, step, fps) AS (VALUES {', '.join(map(_row, range(5)))}),
wd AS (SELECT CAST(vec_id % 5 AS VARCHAR) AS capture_id, (vec_id // 5) * 64 + i AS word_idx, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 1000) AS BIGINT) % 4096 AS v FROM embeddings, range(64) t(i)),
whole AS (SELECT capture_id, least(any_value(frames), count(*) // any_value(fw)) AS n FROM wd JOIN par USING (capture_id) GROUP BY capture_id),
pl AS (SELECT *, o // (lanes * CASE WHEN isreal THEN 1 ELSE 2 END) * lanes + o % lanes AS s, (o // lanes) % CASE WHEN isreal THEN 1 ELSE 2 END AS half FROM (SELECT *, word_idx // fw AS frame, word_idx % fw AS o FROM wd JOIN par USING (capture_id) JOIN whole USING (capture_id)) WHERE frame < n),
sc AS (SELECT capture_id, frame, s // (ns * nrx) AS chirp, CASE WHEN inter THEN s % nrx ELSE s % (ns * nrx) // ns END AS rx, CASE WHEN inter THEN s % (ns * nrx) // nrx ELSE s % ns END AS n,
  any_value(ns) AS ns, any_value(bins) AS bins, any_value(stride) AS stride, max(CASE WHEN half = CASE WHEN swap THEN 1 ELSE 0 END THEN v END) / 32767 AS re, coalesce(max(CASE WHEN half = CASE WHEN swap THEN 0 ELSE 1 END THEN v END), 0) / 32767 AS im FROM pl GROUP BY 1, 2, 3, 4, 5),
sw AS (SELECT *, (re - avg(re) OVER w) * (0.5 - 0.5 * cos({PI2!r} * n / (ns - 1))) AS a, (im - avg(im) OVER w) * (0.5 - 0.5 * cos({PI2!r} * n / (ns - 1))) AS b FROM sc WHERE chirp % stride = 0 WINDOW w AS (PARTITION BY capture_id, frame, chirp, rx)),
sf AS (SELECT capture_id, frame, chirp // stride AS l, rx, k, bins, {_dft('k', 'n', 'ns')} FROM (SELECT capture_id, frame, chirp, stride, rx, n, ns, bins, a AS re, b AS im FROM sw), range(16) t(k) WHERE k < bins GROUP BY ALL),
dl AS (SELECT capture_id, frame, l, rx, k, bins, (re - avg(re) OVER w) * (0.5 - 0.5 * cos({PI2!r} * l / 7)) AS re, (im - avg(im) OVER w) * (0.5 - 0.5 * cos({PI2!r} * l / 7)) AS im FROM sf WINDOW w AS (PARTITION BY capture_id, frame, rx, k)),
dz AS (SELECT capture_id, frame, rx, k, bins, (d + 4) % 8 AS d, {_dft('d', 'l', '8')} FROM dl, range(8) t(d) GROUP BY capture_id, frame, rx, k, bins, d),
rd AS (SELECT capture_id, frame, d, k AS r, bins, sqrt(sum(re * re + im * im)) AS mag FROM dz GROUP BY ALL)"""


def _recordings(spark, sf_dir):
    words, logs = derived.recordings(spark, sf_dir)
    return recorded.cut_words(words, recorded.settings(logs))


@query(f"WITH {_RD} SELECT capture_id, frame, d AS doppler_idx, r AS range_idx, round(mag, 6) AS mag FROM rd")
def w1_recorded_maps(spark, sf_dir):
    return _longs(rounded(ranges.cells(recorded.range_doppler(_recordings(spark, sf_dir), None))))


@query(f"""WITH RECURSIVE {_RD},
noise AS (SELECT x.capture_id, x.frame, x.d, x.r, any_value(x.mag) AS mag, avg(y.mag) AS noise FROM rd x JOIN rd y ON x.capture_id = y.capture_id AND x.frame = y.frame AND abs(x.d - y.d) <= 2 AND abs(x.r - y.r) <= 2 AND (abs(x.d - y.d) > 1 OR abs(x.r - y.r) > 1)
  WHERE x.d BETWEEN 2 AND 5 AND x.r BETWEEN 2 AND x.bins - 3 GROUP BY ALL),
h AS (SELECT capture_id, frame, d, r, mag FROM noise WHERE mag > 1.5 * noise),
reach AS (SELECT capture_id, frame, d, r, d * 32 + r AS root FROM h UNION SELECT h.capture_id, h.frame, h.d, h.r, reach.root FROM reach JOIN h ON h.capture_id = reach.capture_id AND h.frame = reach.frame AND abs(h.d - reach.d) + abs(h.r - reach.r) = 1),
l AS (SELECT capture_id, frame, d, r, min(root) AS root FROM reach GROUP BY ALL),
n AS (SELECT *, dense_rank() OVER (PARTITION BY capture_id, frame ORDER BY root) AS label FROM l JOIN h USING (capture_id, frame, d, r))
SELECT capture_id, frame, label, d AS doppler_idx, r AS range_idx, round(mag, 6) AS magnitude, round(r * width, 6) AS range_m, round((d - 4) * step, 6) + 0.0 AS velocity_ms FROM n JOIN par USING (capture_id)
QUALIFY row_number() OVER (PARTITION BY capture_id, frame, label ORDER BY mag DESC, d, r) = 1""")
def w1_recorded_targets(spark, sf_dir):
    return _longs(rounded(recorded.targets(_recordings(spark, sf_dir), None, 1, 1, 1.5)))


@query(f"WITH {_RD},\nv AS (SELECT capture_id, frame, avg(mag) AS signal FROM rd WHERE r BETWEEN 1 AND 7 GROUP BY capture_id, frame)," + _AMPLITUDES.replace("15.0", "fps").replace("FROM s, range", "FROM s JOIN par USING (capture_id), range").replace("capture_id, k, nf\n", "capture_id, k, nf, fps\n").replace("k, nf)", "k, nf, fps)") + _SHARES)
def w3_recorded_vitals(spark, sf_dir):
    return rounded(recorded.vital_signs(_recordings(spark, sf_dir), None, 4, 3), 4)


#: Metres at which the angle spectra and the displacement of recordings are taken: another bin by range step.
_METRES = 2.0
_BIN = f"kb AS (SELECT capture_id, CAST(round({_METRES} / width) AS INT) AS kb FROM par)"


@query(f"""WITH {_RD},
{_BIN},
aw AS (SELECT *, (re - avg(re) OVER w) * (0.5 - 0.5 * cos({PI2!r} * n / (ns - 1))) AS a, (im - avg(im) OVER w) * (0.5 - 0.5 * cos({PI2!r} * n / (ns - 1))) AS b FROM sc WINDOW w AS (PARTITION BY capture_id, frame, chirp, rx)),
af AS (SELECT capture_id, frame, chirp // stride AS l, (chirp % stride) * nrx + rx AS ant, stride * nrx AS na, kb, {_dft('kb', 'n', 'ns')} FROM (SELECT aw.capture_id, frame, chirp, rx, n, aw.ns, aw.stride, nrx, kb, a AS re, b AS im FROM aw JOIN par USING (capture_id) JOIN kb USING (capture_id)) GROUP BY ALL),
st AS (SELECT capture_id, frame, l, ant, na, kb, (re - avg(re) OVER w) * h AS re, (im - avg(im) OVER w) * h AS im, {PI2!r} * CASE WHEN capture_id = '0' THEN CAST([0, 0.4, 1.1, 1.5] AS DOUBLE[])[ant + 1] ELSE 0.5 * (ant - (na - 1) / 2.0) END AS x FROM (SELECT *, 0.54 - 0.46 * cos({PI2!r} * ant / (na - 1)) AS h FROM af) WINDOW w AS (PARTITION BY capture_id, frame, ant)),
bm AS (SELECT capture_id, frame, kb, l, a, sum(re * cos(x * sin(radians(a - 90))) + im * sin(x * sin(radians(a - 90)))) ** 2 + sum(im * cos(x * sin(radians(a - 90))) - re * sin(x * sin(radians(a - 90)))) ** 2 AS p FROM st, range(181) t(a) GROUP BY ALL),
db AS (SELECT capture_id, frame, kb, a, 10 * log10(greatest(avg(p), 1e-12)) AS db FROM bm GROUP BY ALL)
SELECT capture_id, frame, kb AS range_idx, a AS angle_idx, round(db - max(db) OVER (PARTITION BY capture_id, frame), 4) + 0.0 AS db FROM db""")
def w1_recorded_angles(spark, sf_dir):
    return _longs(rounded(ranges.cells(recorded.angle_spectrum(_recordings(spark, sf_dir), _METRES, None), "angle_idx", "db"), 4))


@query(f"""WITH {_RD},
{_BIN},
ph AS (SELECT capture_id, rx, frame AS t, atan2(im, re) AS p FROM sf JOIN kb USING (capture_id) WHERE l = 0 AND k = kb),
tn AS (SELECT *, CASE WHEN p - lag(p) OVER w > pi() THEN -1 WHEN p - lag(p) OVER w <= -pi() THEN 1 ELSE 0 END AS turn FROM ph WINDOW w AS (PARTITION BY capture_id, rx ORDER BY t)),
dp AS (SELECT capture_id, rx, t, fps, CAST(greatest(1, round_even(0.5 * fps, 0)) AS INT) AS half, max(t) OVER (PARTITION BY capture_id, rx) AS last, (p + {PI2!r} * sum(turn) OVER (PARTITION BY capture_id, rx ORDER BY t)) * (step * 2 * 8 * 50e-6 * stride / {4 * np.pi!r}) AS x FROM tn JOIN par USING (capture_id))
SELECT d.capture_id, d.rx, d.t, round(sum(x.x * {band_pass_sql(0.1, '0.6', 'd.fps', 'd.half')}), 9) + 0.0 AS breathing_m, round(sum(x.x * {band_pass_sql(0.8, '3.5', 'd.fps', 'd.half')}), 9) + 0.0 AS heart_m
FROM dp d, range(-40, 41) r(j), dp x WHERE x.capture_id = d.capture_id AND x.rx = d.rx AND abs(j) <= d.half AND x.t = greatest(0, least(d.last, d.t - j)) GROUP BY d.capture_id, d.rx, d.t""")
def w3_recorded_displacement(spark, sf_dir):
    moved = recorded.displacement(_recordings(spark, sf_dir), _METRES, None)
    return _longs(rounded(temporal.displacement_bands(moved, "fps", 0.5, 16), 9))


@query(f"WITH {_RD} SELECT capture_id, frame, d AS doppler_idx, round(20 * log10(sum(mag) + 1e-12), 4) AS db FROM rd WHERE r BETWEEN 2 AND 6 GROUP BY ALL")
def w1_recorded_micro_doppler(spark, sf_dir):
    return _longs(rounded(recorded.micro_doppler(_recordings(spark, sf_dir), 6, 2, None), 4))


@query(f"""WITH {_RD},
ax AS (SELECT *, (re - avg(re) OVER w) * (0.5 - 0.5 * cos({PI2!r} * n / (ns - 1))) AS a, (im - avg(im) OVER w) * (0.5 - 0.5 * cos({PI2!r} * n / (ns - 1))) AS b FROM sc WHERE chirp % stride = stride - 1 WINDOW w AS (PARTITION BY capture_id, frame, chirp, rx)),
ak AS (SELECT capture_id, frame, chirp, rx, k, {_dft('k', 'n', 'ns')} FROM (SELECT capture_id, frame, chirp, rx, n, ns, bins, a AS re, b AS im FROM ax), range(16) t(k) WHERE k < bins GROUP BY ALL),
pr AS (SELECT ak.capture_id, frame, k, avg((sqrt(re * re + im * im) + 1e-9) * CASE WHEN isreal THEN 2 ELSE 1 END) AS mag FROM ak JOIN par USING (capture_id) GROUP BY ALL)
SELECT capture_id, frame, k AS range_idx, round(greatest(mag - 0.8 * avg(mag) OVER (PARTITION BY capture_id, k), 1e-9), 6) AS mag FROM pr""")
def w1_recorded_background(spark, sf_dir):
    return _longs(rounded(recorded.frame_profiles(_recordings(spark, sf_dir), None, 0.8, 1)))
