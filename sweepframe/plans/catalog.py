"""Registered queries of the radar operators: sources, cubes, spectra, angles, time, detection, design.

Every query reads the given tables through sources.derived; its SQL computes the
same rows from the same tables. Numbers are rounded on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions import ranksketch
from sweepframe.functions.signal import C0, bin_width_m, db20, velocity_step, windowed, without_mean
from sweepframe.operators import angles, cube, design, detection, doppler, logconfig, ranges, temporal, tiles
from sweepframe.plans import workflows
from sweepframe.sources import captures, derived

_queries: dict = {}
_sql: dict[str, str] = {}
STEP = bin_width_m(32, derived.RADAR["rate"], derived.RADAR["slope"])
V_STEP = velocity_step(8, 100e-6, derived.RADAR["start_hz"])
PI2 = 2 * np.pi


def query(sql: str | None = None):
    def add(function):
        _queries[function.__name__] = function
        if sql:
            _sql[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating-point columns rounded (minus zero becomes zero); capture_id is left out where it is one constant."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def parts(*names: str, last: str) -> str:
    """A WITH query of the named common tables."""
    return "WITH " + ",\n".join(f"{n} AS ({COMMON[n]})" for n in names) + "\n" + last


def hann(n: str, size: int) -> str:
    return f"(0.5 - 0.5 * cos({PI2!r} * {n} / {size - 1}))"


COMMON = {
    "e": "SELECT vec_id // 32 AS frame, (vec_id // 2) % 16 AS chirp, vec_id % 2 AS rx, embedding FROM embeddings WHERE vec_id // 32 < (SELECT count(*) // 32 FROM embeddings)",
    "es": "SELECT frame, chirp, rx, n, CAST(embedding[2 * n + 1] AS DOUBLE) AS re, CAST(embedding[2 * n + 2] AS DOUBLE) AS im FROM e, range(32) t(n)",
    "ew": f"SELECT frame, chirp, rx, n, (re - avg(re) OVER w) * {hann('n', 32)} AS re, (im - avg(im) OVER w) * {hann('n', 32)} AS im FROM es WINDOW w AS (PARTITION BY frame, chirp, rx)",
    "ef": f"SELECT frame, chirp, rx, k, sum(re * cos({PI2!r} * ((k * n) % 32) / 32) + im * sin({PI2!r} * ((k * n) % 32) / 32)) AS re, sum(im * cos({PI2!r} * ((k * n) % 32) / 32) - re * sin({PI2!r} * ((k * n) % 32) / 32)) AS im FROM ew, range(32) t(k) GROUP BY frame, chirp, rx, k",
    "em": "SELECT frame, chirp, rx, k, sqrt(re * re + im * im) + 1e-9 AS mag FROM ef",
    "rs": "SELECT frame, chirp, rx, n, CAST(embedding[n + 1] AS DOUBLE) AS re FROM e, range(64) t(n)",
    "rf": f"SELECT frame, chirp, rx, k, sum(re * cos({PI2!r} * ((k * n) % 64) / 64)) AS re, -sum(re * sin({PI2!r} * ((k * n) % 64) / 64)) AS im FROM (SELECT frame, chirp, rx, n, (re - avg(re) OVER (PARTITION BY frame, chirp, rx)) * {hann('n', 64)} AS re FROM rs), range(33) t(k) GROUP BY frame, chirp, rx, k",
    "dl": f"SELECT frame, rx, k, chirp // 2 AS l, (re - avg(re) OVER w) * {hann('(chirp // 2)', 8)} AS re, (im - avg(im) OVER w) * {hann('(chirp // 2)', 8)} AS im FROM ef WHERE chirp % 2 = 0 WINDOW w AS (PARTITION BY frame, rx, k)",
    "dz": f"SELECT frame, rx, k, (d + 4) % 8 AS d, sum(re * cos({PI2!r} * ((d * l) % 8) / 8) + im * sin({PI2!r} * ((d * l) % 8) / 8)) AS re, sum(im * cos({PI2!r} * ((d * l) % 8) / 8) - re * sin({PI2!r} * ((d * l) % 8) / 8)) AS im FROM dl, range(8) t(d) GROUP BY frame, rx, k, d",
    "rd": "SELECT frame, d, k, sqrt(sum(re * re + im * im)) AS mag FROM dz GROUP BY frame, d, k",
    "va": "SELECT frame, chirp // 2 AS l, (chirp % 2) * 2 + rx AS ant, k, re, im FROM ef",
    "vs": "SELECT frame, l, ant, k, re - avg(re) OVER w AS re, im - avg(im) OVER w AS im FROM va WINDOW w AS (PARTITION BY frame, ant, k)",
    "bp": f"SELECT frame, k, a, avg(p) AS p FROM (SELECT frame, l, k, a, sum(h * (re * cos(f) + im * sin(f))) ** 2 + sum(h * (im * cos(f) - re * sin(f))) ** 2 AS p FROM (SELECT frame, l, k, a, re, im, 0.54 - 0.46 * cos({PI2!r} * ant / 3) AS h, {PI2!r} * sin(radians(a)) * (0.5 * ant - 0.75) AS f FROM vs, range(-90, 91) t(a) WHERE k <= 16) GROUP BY frame, l, k, a) GROUP BY frame, k, a",
    "ra": "SELECT frame, k, (a + 90 + 90) % 181 AS a, 10 * log10(greatest(p, 1e-12)) - max(10 * log10(greatest(p, 1e-12))) OVER (PARTITION BY frame) AS db FROM bp",
    "w": "SELECT event_id AS word_idx, CAST(floor(value * 100) AS BIGINT) % 4096 - 2048 AS v FROM events",
    "g": "SELECT event_id // 512 AS frame, (event_id // 32) % 16 AS d, event_id % 32 AS r, CAST(value AS DOUBLE) AS mag FROM events WHERE event_id // 512 < (SELECT count(*) // 512 FROM events)",
    "v": "SELECT user_id AS capture_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, CAST(value AS DOUBLE) AS signal FROM events",
}


def words_sql(lanes: int, real: bool, swap: bool = False, order: list[int] | None = None) -> str:
    size = lanes if real else 2 * lanes
    lane = f"(word_idx % {size}) % {lanes}"
    if order:
        lane = f"([{', '.join(str(order.index(k)) for k in range(lanes))}])[{lane} + 1]"
    s = f"(word_idx // {size}) * {lanes} + {lane}"
    whole = f"word_idx // {size} < (SELECT count(*) // {size} FROM w)"
    if real:
        return f"SELECT {s} AS s, CAST(v AS DOUBLE) AS i, CAST(NULL AS DOUBLE) AS q FROM w WHERE {whole}"
    i, q = (f"CAST(max(CASE WHEN word_idx % {size} {op} {lanes} THEN v END) AS DOUBLE)" for op in ("<", ">="))
    return f"SELECT {s} AS s, {q if swap else i} AS i, {i if swap else q} AS q FROM w WHERE {whole} GROUP BY 1"


def address_sql(n: int, rx: int, chirps: int, interleaved: bool) -> str:
    base = n * rx
    rx_sql, n_sql = (f"(s % {base}) % {rx}", f"(s % {base}) // {rx}") if interleaved else (f"(s % {base}) // {n}", f"(s % {base}) % {n}")
    return f"SELECT s // {base} // {chirps} AS frame, (s // {base}) % {chirps} AS chirp, {rx_sql} AS rx, {n_sql} AS n, i, q FROM c WHERE s // {base} // {chirps} < (SELECT greatest(1, count(*) // {base * chirps}) FROM c)"


# ---------------------------------------------------------------- sources and sinks


def _files(spark, sf_dir):
    s = derived.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    caps = s.select(F.lit("d").alias("dir"), F.concat(F.lit("cap_"), k, F.when(F.col("s_suppkey") % 2 == 0, "_Raw_0.bin").otherwise(".bin")).alias("file_name"))
    logs = s.where("s_suppkey % 10 != 9").select(F.lit("d").alias("dir"), F.concat(F.lit("cap_"), k, F.lit("_LogFile.txt")).alias("log_name"))
    return caps, logs


_FILES = "SELECT 'd' AS dir, 'cap_' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '_Raw_0.bin' ELSE '.bin' END AS file_name, s_suppkey AS k FROM supplier"


@query(f"SELECT dir, file_name, CASE WHEN k % 10 <> 9 THEN 'cap_' || k || '_LogFile.txt' END AS log_name FROM ({_FILES})")
def s3_pair_logs(spark, sf_dir):
    return captures.pair_logs(*_files(spark, sf_dir))


@query(f"SELECT dir, file_name FROM ({_FILES}) WHERE k % 10 = 9")
def s3_missing_logs(spark, sf_dir):
    return captures.without_log(*_files(spark, sf_dir))


@query(parts("g", last="SELECT frame, d * 32 + r AS place, round(mag, 6) AS mag FROM g"))
def s4_matrix_rows(spark, sf_dir):
    rows = captures.matrix_rows(derived.grid(spark, sf_dir), ["frame"], ["doppler_idx", "range_idx"], "mag")
    return rounded(rows.select(F.col("frame").cast("long").alias("frame"), F.posexplode("flat").alias("place", "mag")).withColumn("place", F.col("place").cast("long")))


# ---------------------------------------------------------------- cubes


@query(parts("w", last=words_sql(2, False)))
def c1_demux_complex(spark, sf_dir):
    return cube.demux(derived.raw_words(spark, sf_dir), 2).drop("capture_id")


@query(parts("w", last=words_sql(1, False)))
def c1_demux_one_lane(spark, sf_dir):
    return cube.demux(derived.raw_words(spark, sf_dir), 1).drop("capture_id")


@query(parts("w", last=words_sql(4, True)))
def c1_demux_real(spark, sf_dir):
    return cube.demux(derived.raw_words(spark, sf_dir), 4, real=True).drop("capture_id")


@query(parts("w", last=words_sql(4, False, False, [0, 2, 1, 3])))
def c2_lane_order(spark, sf_dir):
    return cube.demux(derived.raw_words(spark, sf_dir), 4, lane_order=[0, 2, 1, 3]).drop("capture_id")


@query(parts("w", last=words_sql(2, False, True)))
def c3_iq_swap(spark, sf_dir):
    return cube.demux(derived.raw_words(spark, sf_dir), 2, swap=True).drop("capture_id")


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _addressed(spark, sf_dir, interleaved):
    return cube.address(cube.demux(derived.raw_words(spark, sf_dir), 2), 16, 2, 4, interleaved)


@query("WITH w AS (" + COMMON["w"] + "), c AS (" + words_sql(2, False) + ")\n" + address_sql(16, 2, 4, True))
def c4_address_interleaved(spark, sf_dir):
    return _longs(_addressed(spark, sf_dir, True).drop("capture_id"))


@query("WITH w AS (" + COMMON["w"] + "), c AS (" + words_sql(2, False) + ")\n" + address_sql(16, 2, 4, False))
def c4_address_blocks(spark, sf_dir):
    return _longs(_addressed(spark, sf_dir, False).drop("capture_id"))


_CUBE = "WITH w AS (" + COMMON["w"] + "), c AS (" + words_sql(2, False) + "), x AS (" + address_sql(16, 2, 4, False) + ")\nSELECT frame, chirp, rx, n, round(i / 32767, 6) AS re, round(q / 32767, 6) AS im FROM x"


@query(_CUBE)
def c6_full_scale_cube(spark, sf_dir):
    whole = cube.gather(_addressed(spark, sf_dir, False), 16)
    return _longs(rounded(whole.select("frame", "chirp", "rx", F.posexplode(F.arrays_zip("re", "im")).alias("n", "z")).select("frame", "chirp", "rx", "n", "z.re", "z.im")))


@query(_CUBE)
def c6_decode_frames(spark, sf_dir):
    frames = derived.raw_words(spark, sf_dir).groupBy("capture_id", F.expr("word_idx div 256").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("word_idx", "v")))["v"].alias("words"))
    whole = cube.decode_frames(frames, 2, 16, 2, 4, False, bits=16)
    return _longs(rounded(whole.select("frame", "chirp", "rx", F.posexplode(F.arrays_zip("re", "im")).alias("n", "z")).select("frame", "chirp", "rx", "n", "z.re", "z.im")))


@query(parts("e", "es", last="SELECT frame, (chirp // 4) * 2 + CASE chirp % 4 WHEN 3 THEN 0 ELSE 1 END AS chirp, rx, round(sum(re), 6) AS total FROM es WHERE chirp % 4 IN (3, 1) GROUP BY ALL"))
def c7_select_positions(spark, sf_dir):
    picked = cube.select_positions(derived.complex_cube(spark, sf_dir), [3, 1], 4, 16)
    return _longs(rounded(picked.select("frame", "chirp", "rx", F.aggregate("re", F.lit(0.0), lambda s, v: s + v).alias("total"))))


# ---------------------------------------------------------------- range


@query(parts("e", "es", last="SELECT frame, chirp, rx, n, round(re - avg(re) OVER w, 6) + 0.0 AS re, round(im - avg(im) OVER w, 6) + 0.0 AS im FROM es WINDOW w AS (PARTITION BY frame, chirp, rx)"))
def r1_remove_dc(spark, sf_dir):
    x = derived.complex_cube(spark, sf_dir).select("frame", "chirp", "rx", F.posexplode(F.arrays_zip(without_mean(F.col("re")).alias("re"), without_mean(F.col("im")).alias("im"))).alias("n", "z"))
    return _longs(rounded(x.select("frame", "chirp", "rx", "n", "z.re", "z.im")))


@query(parts("e", "es", last=f"SELECT frame, chirp, rx, n, round(re * (0.54 - 0.46 * cos({PI2!r} * n / 31)), 6) + 0.0 AS re FROM es"))
def r2_window(spark, sf_dir):
    x = derived.complex_cube(spark, sf_dir).select("frame", "chirp", "rx", F.posexplode(windowed(F.col("re"), "hamming")).alias("n", "re"))
    return _longs(rounded(x))


def _spectrum(spark, sf_dir, **how):
    return ranges.range_fft(derived.complex_cube(spark, sf_dir), 32, **how)


def _cells(df: DataFrame) -> DataFrame:
    keys = [c for c in df.columns if c not in ("re", "im", "capture_id")]
    return df.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias("range_idx", "z")).select(*keys, "range_idx", "z.re", "z.im")


@query(parts("e", "es", "ew", "ef", last="SELECT frame, chirp, rx, k AS range_idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM ef"))
def r3_range_fft(spark, sf_dir):
    return _longs(rounded(_cells(_spectrum(spark, sf_dir))))


@query(parts("e", "es", "ew", "ef", last="SELECT frame, chirp, rx, k AS range_idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM ef WHERE k <= 16"))
def r3_range_fft_half(spark, sf_dir):
    return _longs(rounded(_cells(_spectrum(spark, sf_dir, full=False))))


@query(parts("e", "rs", "rf", last="SELECT frame, chirp, rx, k AS range_idx, round((sqrt(re * re + im * im) + 1e-9) * 2, 6) AS mag FROM rf"))
def r3_range_fft_real(spark, sf_dir):
    mags = ranges.with_magnitude(ranges.range_fft(derived.real_cube(spark, sf_dir), real=True), real=True)
    return _longs(rounded(ranges.cells(mags).drop("capture_id")))


@query(parts("e", "es", "ew", "ef", "em", last=f"SELECT frame, chirp, rx, k AS range_idx, round(mag, 6) AS mag, round(k * {STEP!r}, 6) AS range_m FROM em"))
def r4_magnitude_and_axis(spark, sf_dir):
    rows = ranges.cells(ranges.with_magnitude(_spectrum(spark, sf_dir))).drop("capture_id")
    return _longs(rounded(rows.withColumn("range_m", ranges.range_m(F.col("range_idx"), STEP))))


_PROFILE = parts("e", "es", "ew", "ef", "em", last="SELECT frame, k, avg(mag) AS mag FROM em GROUP BY frame, k")


def _profile(spark, sf_dir):
    return ranges.frame_profile(ranges.with_magnitude(_spectrum(spark, sf_dir)))


@query(f"SELECT frame, k AS range_idx, round(20 * log10(mag + 1e-9), 4) AS db FROM ({_PROFILE})")
def r6_frame_profile(spark, sf_dir):
    return _longs(rounded(_profile(spark, sf_dir).select("frame", "range_idx", db20(F.col("mag")).alias("db")), 4))


@query(f"SELECT frame, k AS range_idx, round(greatest(mag - 0.8 * avg(mag) OVER (PARTITION BY k), 1e-9), 6) AS mag FROM ({_PROFILE})")
def r7_background(spark, sf_dir):
    return _longs(rounded(ranges.remove_background(_profile(spark, sf_dir), 0.8).drop("capture_id")))


@query(f"SELECT round(quantile_cont(20 * log10(mag + 1e-9), 0.05), 4) AS vmin, round(quantile_cont(20 * log10(mag + 1e-9), 0.99) + 5, 4) AS vmax FROM ({_PROFILE})")
def r8_display_limits(spark, sf_dir):
    return rounded(ranges.display_limits(_profile(spark, sf_dir), db20(F.col("mag")), 5, 99, 5).drop("capture_id"), 4)


@query(f"SELECT round(quantile_cont(20 * log10(mag + 1e-9), 0.05), 4) AS vmin, round(quantile_cont(20 * log10(mag + 1e-9), 0.99) + 5, 4) AS vmax FROM ({_PROFILE})")
def r8_limits_of_sketches(spark, sf_dir):
    rows = _profile(spark, sf_dir).select("capture_id", "frame", db20(F.col("mag")).alias("db"))
    earlier, later = (ranksketch.sketch(rows.where(F.col("frame") % 3 == 0 if first else F.col("frame") % 3 != 0), F.col("db"), 0.25) for first in (True, False))
    return rounded(ranges.limits_of_sketch(rows, F.col("db"), ranksketch.merged(earlier, later), 5, 99, 0.25, 5).drop("capture_id"), 4)


_RTI = parts("e", "es", "ew", "ef", "em", last="SELECT frame * 16 + chirp AS t, k, avg(mag) AS mag FROM em GROUP BY ALL")


@query(f"SELECT t, k AS range_idx, round(mag, 6) AS mag FROM ({_RTI})")
def r9_range_time(spark, sf_dir):
    return _longs(rounded(ranges.range_time(ranges.with_magnitude(_spectrum(spark, sf_dir)), 16).drop("capture_id")))


@query(f"WITH m AS ({_RTI}) SELECT t, k AS range_idx, round(CASE WHEN k < 2 OR k >= 30 THEN (SELECT quantile_cont(mag, 0.01) FROM m WHERE k BETWEEN 10 AND 15) ELSE mag END, 6) AS mag FROM m")
def r10_notch(spark, sf_dir):
    return _longs(rounded(workflows.range_time(derived.complex_cube(spark, sf_dir), 16, 32).drop("capture_id")))


@query(parts("e", "es", last=f"""SELECT frame, rx, k AS range_idx, round(20 * log10(sqrt(re * re + im * im) / (32 * 0.484375) + 1e-9), 4) AS dbfs
FROM (SELECT frame, rx, k, sum(re * cos({PI2!r} * ((k * n) % 32) / 32) + im * sin({PI2!r} * ((k * n) % 32) / 32)) AS re, sum(im * cos({PI2!r} * ((k * n) % 32) / 32) - re * sin({PI2!r} * ((k * n) % 32) / 32)) AS im
FROM (SELECT frame, rx, n, (re - avg(re) OVER w) * {hann('n', 32)} AS re, (im - avg(im) OVER w) * {hann('n', 32)} AS im FROM (SELECT frame, rx, n, avg(re) AS re, avg(im) AS im FROM es GROUP BY frame, rx, n) WINDOW w AS (PARTITION BY frame, rx)), range(17) t(k) GROUP BY frame, rx, k)"""))
def r11_profile_dbfs(spark, sf_dir):
    return _longs(rounded(ranges.profile_dbfs(derived.complex_cube(spark, sf_dir), 32).drop("capture_id"), 4))


# ---------------------------------------------------------------- Doppler


@query(parts("e", "es", last="SELECT frame, rx, chirp // 2 AS loop, round(sum(re), 6) AS total FROM es WHERE chirp % 2 = 0 GROUP BY ALL"))
def d1_separate(spark, sf_dir):
    rows = doppler.separate(derived.complex_cube(spark, sf_dir), doppler.transmit_positions([1, 2], 2), 2, 16)
    return _longs(rounded(rows.select("frame", "rx", "loop", F.aggregate("re", F.lit(0.0), lambda s, v: s + v).alias("total"))))


@query(parts("e", "es", last="SELECT frame, rx, chirp // 2 AS loop, n, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM es GROUP BY ALL"))
def d1_separate_mean(spark, sf_dir):
    rows = doppler.separate(derived.complex_cube(spark, sf_dir), [0, 1], 2, 16)
    return _longs(rounded(_cells(rows).withColumnRenamed("range_idx", "n")))


def _rd(spark, sf_dir, mode="MRC"):
    return doppler.range_doppler(derived.complex_cube(spark, sf_dir), [0], 2, 16, 32, mode=mode)


_DZ = ("e", "es", "ew", "ef", "dl", "dz")


@query(parts(*_DZ, "rd", last="SELECT frame, d AS doppler_idx, k AS range_idx, round(mag, 6) AS mag FROM rd"))
def d4_range_doppler(spark, sf_dir):
    return _longs(rounded(ranges.cells(_rd(spark, sf_dir)).drop("capture_id")))


@query(parts(*_DZ, last="SELECT frame, d AS doppler_idx, k AS range_idx, round(sqrt(sum(re) ** 2 + sum(im) ** 2), 6) AS mag FROM dz GROUP BY ALL"))
def d5_combine_sum(spark, sf_dir):
    return _longs(rounded(ranges.cells(_rd(spark, sf_dir, "SUM")).drop("capture_id")))


@query(parts(*_DZ, last="SELECT frame, d AS doppler_idx, k AS range_idx, round(sqrt(re * re + im * im), 6) AS mag FROM dz WHERE rx = 1"))
def d5_combine_rx1(spark, sf_dir):
    return _longs(rounded(ranges.cells(_rd(spark, sf_dir, "RX1")).drop("capture_id")))


@query(parts(*_DZ, "rd", last="SELECT frame, d AS doppler_idx, round(20 * log10(sum(mag) + 1e-12), 4) AS db FROM rd WHERE k BETWEEN 5 AND 20 GROUP BY ALL"))
def d7_micro_doppler(spark, sf_dir):
    return _longs(rounded(doppler.micro_doppler(_rd(spark, sf_dir), 20, 5).drop("capture_id"), 4))


@query(parts(*_DZ, "rd", last="SELECT frame, k AS range_idx, round(20 * log10(avg(mag) + 1e-9), 4) AS db FROM rd GROUP BY ALL"))
def d8_mean_profile(spark, sf_dir):
    return _longs(rounded(doppler.mean_profile(_rd(spark, sf_dir)).select("frame", "range_idx", db20(F.col("mag")).alias("db")), 4))


@query(parts(*_DZ, "rd", last="SELECT d AS doppler_idx, round(20 * log10(mag + 1e-9), 4) AS db FROM rd WHERE frame = 3 AND k = 7"))
def d9_at_bin(spark, sf_dir):
    return _longs(rounded(doppler.at_bin(_rd(spark, sf_dir), 3, 7).drop("capture_id"), 4))


@query(parts(*_DZ, "rd", last=f"SELECT frame, round((d - 4) * {V_STEP!r}, 4) + 0.0 AS velocity_ms, d AS doppler_idx, k AS range_idx, round(20 * log10(mag + 1e-9), 4) AS db FROM rd WHERE (d - 4) * {V_STEP!r} BETWEEN -5 AND 5"))
def d10_zoom(spark, sf_dir):
    return _longs(rounded(doppler.zoom(_rd(spark, sf_dir), 8, V_STEP).drop("capture_id"), 4))


# ---------------------------------------------------------------- angles


def _snapshots(spark, sf_dir, mode="MIMO", full=True):
    return angles.virtual_array(_spectrum(spark, sf_dir, full=full), 2, 2, mode)


X4, Y4 = angles.geometry(4, 2)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS capture_id, s_suppkey % 2 = 1 AS safe FROM supplier")
def a1_safe_tdm(spark, sf_dir):
    # chirp 1 transmits from mask 4 (even) or 2 (odd), chirp 0 from mask 1; an even capture also gets a two-transmitter place
    k = F.col("s_suppkey")
    pattern = derived.table(spark, sf_dir, "supplier").select(k.cast("string").alias("capture_id"), F.posexplode(F.when(k % 2 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(4), F.lit(5)))).alias("pos", "tx_mask"))
    return angles.is_safe_tdm(pattern)


@query(parts("e", "es", "ew", "ef", "va", last="SELECT frame, l AS loop, ant, k AS range_idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM va"))
def a2_virtual_array(spark, sf_dir):
    return _longs(rounded(_cells(_snapshots(spark, sf_dir))))


@query(parts("e", "es", "ew", "ef", last="SELECT frame, chirp // 2 AS loop, rx AS ant, k AS range_idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM ef WHERE chirp % 2 = 0"))
def a3_first_tx(spark, sf_dir):
    return _longs(rounded(_cells(_snapshots(spark, sf_dir, "First TX"))))


@query(parts("e", last="SELECT frame, (chirp % 2) * 2 + rx AS ant, 0.5 * ((chirp % 2) * 2 + rx) - 0.75 AS x, count(*) AS loops FROM e GROUP BY ALL"))
def a4_geometry(spark, sf_dir):
    x = F.element_at(F.array(*[F.lit(float(v)) for v in X4]), F.col("ant") + 1)
    return _longs(rounded(_snapshots(spark, sf_dir).groupBy("frame", "ant").agg(F.count(F.lit(1)).alias("loops")).withColumn("x", x)))


@query(parts("e", "es", "ew", "ef", "va", last="SELECT frame, l AS loop, ant, k AS range_idx, round(re * cos(f) + im * sin(f), 6) + 0.0 AS re, round(im * cos(f) - re * sin(f), 6) + 0.0 AS im FROM (SELECT *, 0.1 * (ant + 1) AS f FROM va)"))
def a5_calibrate(spark, sf_dir):
    factors = angles.calibration(4, rotation=[0.1, 0.2, 0.3, 0.4])
    return _longs(rounded(_cells(angles.calibrate(_snapshots(spark, sf_dir), factors))))


@query(parts("e", "es", "ew", "ef", "va", "vs", last="SELECT frame, l AS loop, ant, k AS range_idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM vs"))
def a6_remove_static(spark, sf_dir):
    return _longs(rounded(angles.static_removed(_cells(_snapshots(spark, sf_dir)), ["frame", "ant", "range_idx"])))


@query(parts("e", "es", "ew", "ef", "va", last="SELECT frame, l AS loop, CASE ant WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 2 END AS ant, k AS range_idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM va"))
def a7_reorder(spark, sf_dir):
    return _longs(rounded(_cells(angles.reorder(_snapshots(spark, sf_dir), [2, 0, 3, 1], 4))))


@query()
def a8_antenna_order(spark, sf_dir):
    x, _ = angles.geometry(2, 2)
    found = angles.antenna_order(_snapshots(spark, sf_dir, "First TX"), x, 9)
    return found.select("capture_id", F.array_join("antennas", ",").alias("antennas"), "conjugated")


A9 = angles.range_bin_at(32, 3.1, STEP, 16)


@query(parts("e", "es", "ew", "ef", "va", "vs", last=f"""SELECT frame, CAST(a AS DOUBLE) AS angle_deg, round(10 * log10(greatest(p, 1e-12)) - max(10 * log10(greatest(p, 1e-12))) OVER (PARTITION BY frame), 4) + 0.0 AS db FROM (
SELECT frame, a, avg(p) AS p FROM (SELECT frame, l, a, sum(h * (re * cos(f) + im * sin(f))) ** 2 + sum(h * (im * cos(f) - re * sin(f))) ** 2 AS p FROM (
SELECT frame, l, a, re, im, 0.54 - 0.46 * cos({PI2!r} * ant / 3) AS h, {PI2!r} * sin(radians(a)) * (0.5 * ant - 0.75) AS f FROM vs, range(-90, 91) t(a) WHERE k = {A9}) GROUP BY frame, l, a) GROUP BY frame, a)"""))
def a10_angle_spectrum(spark, sf_dir):
    rows = angles.spectrum_at(_snapshots(spark, sf_dir), A9, X4, list(range(-90, 91)))
    return _longs(rounded(rows.drop("capture_id"), 4))


_RA = ("e", "es", "ew", "ef", "va", "vs", "bp", "ra")


def _ra(spark, sf_dir, method="bartlett"):
    return workflows.range_azimuth(derived.complex_cube(spark, sf_dir), derived.RADAR, 2, 32, method)


@query(parts(*_RA, last="SELECT frame, k AS range_idx, a AS angle_idx, round(db, 4) + 0.0 AS db FROM ra"))
def a11_range_azimuth(spark, sf_dir):
    return _longs(rounded(ranges.cells(_ra(spark, sf_dir), "angle_idx", "db").drop("capture_id"), 4))


@query()
def a12_range_azimuth_capon(spark, sf_dir):
    return _longs(rounded(ranges.cells(_ra(spark, sf_dir, "capon"), "angle_idx", "db").drop("capture_id"), 4))


@query(parts("e", "es", "ew", "ef", "va", last=f"""SELECT frame, CAST(el AS DOUBLE) AS el_deg, CAST((((az + 90) // 10 + 9) % 19) * 10 - 90 AS DOUBLE) AS az_deg, round(10 * log10(p / max(p) OVER (PARTITION BY frame) + 1e-12), 4) + 0.0 AS db FROM (
SELECT frame, el, az, sum(re * cos(f) + im * sin(f)) ** 2 + sum(im * cos(f) - re * sin(f)) ** 2 AS p FROM (
SELECT frame, el, az, re, im, {PI2!r} * (sin(radians(az)) * cos(radians(el)) * (0.5 * (ant % 2) - 0.25) + sin(radians(el)) * (0.5 * (ant // 2) - 0.25)) AS f
FROM (SELECT frame, ant, avg(re) AS re, avg(im) AS im FROM va WHERE k = 8 GROUP BY frame, ant), range(-90, 91, 10) u(el), range(-90, 91, 10) v(az)) GROUP BY frame, el, az)"""))
def a13_azimuth_elevation(spark, sf_dir):
    x, y = angles.geometry(4, 2, explicit=([-0.25, 0.25, -0.25, 0.25], [-0.25, -0.25, 0.25, 0.25]))
    grid = list(range(-90, 91, 10))
    return _longs(rounded(angles.azimuth_elevation(_snapshots(spark, sf_dir), 8, x, y, grid, grid).drop("capture_id"), 4))


@query(parts(*_RA, last=f"SELECT frame, k AS range_idx, a AS angle_idx, round(k * {STEP!r} * sin(radians(a - 90)), 6) + 0.0 AS x_m, round(k * {STEP!r} * cos(radians(a - 90)), 6) + 0.0 AS y_m, round(greatest(db, max(db) OVER (PARTITION BY frame) - 35), 4) + 0.0 AS db FROM ra WHERE k * {STEP!r} >= 0.3"))
def a15_cartesian_crop(spark, sf_dir):
    rows = ranges.cells(_ra(spark, sf_dir), "angle_idx", "db").withColumn("angle_deg", (F.col("angle_idx") - 90).cast("double"))
    rows = angles.crop(angles.cartesian(rows, STEP), STEP)
    return _longs(rounded(rows.select("frame", "range_idx", "angle_idx", "x_m", "y_m", F.round("db", 4).alias("db"))))


# ---------------------------------------------------------------- time

_MOVE = parts(*_RA, last=f"""SELECT k AS range_idx, a AS angle_idx, round(10 * log10(en + 1e-12) - max(10 * log10(en + 1e-12)) OVER (), 4) + 0.0 AS db FROM (
SELECT k, a, sum(sqrt(x * x + y * y)) AS en FROM (
SELECT k, a, h, sum(s * cos({PI2!r} * ((h * frame) % nf) / nf)) AS x, sum(s * sin({PI2!r} * ((h * frame) % nf) / nf)) AS y FROM (
SELECT k, a, frame, nf, (lin - avg(lin) OVER (PARTITION BY k, a)) * (0.5 - 0.5 * cos({PI2!r} * frame / (n - 1))) AS s FROM (
SELECT k, a, frame, 10 ** (db / 10) AS lin, n, CAST(2 ** ceil(log2(greatest(32, n))) AS BIGINT) AS nf FROM ra, (SELECT max(frame) + 1 AS n FROM e))), range(0, 4096) t(h)
WHERE h <= nf // 2 AND ((h * 15.0 / nf >= 0.6 AND h * 15.0 / nf < 0.8) OR h * 15.0 / nf > 3.5) GROUP BY k, a, h) GROUP BY k, a)""")


@query(_MOVE)
def t1_movement_map(spark, sf_dir):
    return _longs(rounded(workflows.movement(derived.complex_cube(spark, sf_dir), derived.RADAR, 2, 32).drop("capture_id"), 4))


@query(_MOVE)
def t1_movement_map_by_sums(spark, sf_dir):
    return _longs(rounded(workflows.movement(derived.complex_cube(spark, sf_dir), derived.RADAR, 2, 32, by_sums=True).drop("capture_id"), 4))


@query(_MOVE)
def t1_movement_map_in_steps(spark, sf_dir):
    return _longs(rounded(workflows.movement(derived.complex_cube(spark, sf_dir), derived.RADAR, 2, 32, longest=16).drop("capture_id"), 4))


@query("""SELECT event_id, list_aggregate(list_filter([CASE WHEN hz < 0.1 THEN 'noise' END, CASE WHEN hz >= 0.1 AND hz <= 0.6 THEN 'breathing' END, CASE WHEN hz >= 0.8 AND hz <= 3.5 THEN 'hr' END, CASE WHEN (hz >= 0.6 AND hz < 0.8) OR hz > 3.5 THEN 'movement' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS bands
FROM (SELECT event_id, (event_id % 76) / 10.0::DOUBLE AS hz FROM events)""")
def t2_bands(spark, sf_dir):
    hz = (F.col("event_id") % 76) / F.lit(10.0)
    rows = derived.table(spark, sf_dir, "events").select("event_id", hz.alias("hz"))
    return rows.select("event_id", F.concat_ws(",", *[F.when(temporal.in_band(F.col("hz"), b, 7.5), F.lit(b)) for b in ("noise", "breathing", "hr", "movement")]).alias("bands"))


@query(parts(*_DZ, "rd", last="SELECT frame, round(avg(mag), 6) AS signal FROM rd WHERE k BETWEEN 4 AND 16 GROUP BY frame"))
def t3_source_signal(spark, sf_dir):
    return _longs(rounded(temporal.source_signal(doppler.mean_profile(_rd(spark, sf_dir)), 10, 6).drop("capture_id")))


@query(parts("v", last="SELECT capture_id, frame, count(*) OVER w AS n, round(sum(signal) OVER w, 4) AS total FROM v WINDOW w AS (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN 74 PRECEDING AND CURRENT ROW)"))
def t4_trailing_window(spark, sf_dir):
    rows = temporal.trailing(derived.series(spark, sf_dir))
    return _longs(rounded(rows.select("capture_id", "frame", F.size("signals").alias("n"), F.aggregate("signals", F.lit(0.0), lambda s, v: s + v).alias("total")), 4))


_AMPLITUDES = f"""
c AS (SELECT capture_id, count(*) AS n, CAST(2 ** ceil(log2(greatest(32, count(*)))) AS BIGINT) AS nf FROM v GROUP BY capture_id HAVING count(*) >= 4),
s AS (SELECT capture_id, frame, nf, (signal - avg(signal) OVER (PARTITION BY capture_id)) * (0.5 - 0.5 * cos({PI2!r} * frame / (n - 1))) AS x FROM v JOIN c USING (capture_id)),
f AS (SELECT capture_id, k, k * 15.0 / nf AS hz, sqrt(sum(x * cos({PI2!r} * ((k * frame) % nf) / nf)) ** 2 + sum(x * sin({PI2!r} * ((k * frame) % nf) / nf)) ** 2) AS a FROM s, range(0, 4096) t(k) WHERE k <= nf // 2 GROUP BY capture_id, k, nf)
"""


_SHARES = """SELECT capture_id, round(100 * sum(CASE WHEN hz < 0.1 THEN a ELSE 0 END) / (sum(a) + 1e-12), 4) AS noise_pct, round(100 * sum(CASE WHEN hz >= 0.1 AND hz <= 0.6 THEN a ELSE 0 END) / (sum(a) + 1e-12), 4) AS breathing_pct,
round(100 * sum(CASE WHEN hz >= 0.8 AND hz <= 3.5 THEN a ELSE 0 END) / (sum(a) + 1e-12), 4) AS hr_pct, round(100 * sum(CASE WHEN (hz >= 0.6 AND hz < 0.8) OR hz > 3.5 THEN a ELSE 0 END) / (sum(a) + 1e-12), 4) AS movement_pct,
round(coalesce(max_by(hz, a) FILTER (hz >= 0.1 AND hz <= 0.6), 0), 4) AS br_hz, round(60 * coalesce(max_by(hz, a) FILTER (hz >= 0.1 AND hz <= 0.6), 0), 4) AS br_bpm, round(coalesce(max_by(hz, a) FILTER (hz >= 0.8 AND hz <= 3.5), 0), 4) AS hr_hz, round(60 * coalesce(max_by(hz, a) FILTER (hz >= 0.8 AND hz <= 3.5), 0), 4) AS hr_bpm
FROM f GROUP BY capture_id"""
_VITALS = f"WITH v AS ({COMMON['v']})," + _AMPLITUDES


@query(_VITALS + _SHARES)
def t5_vitals(spark, sf_dir):
    return rounded(temporal.vitals(derived.series(spark, sf_dir)), 4)


@query(_VITALS + _SHARES)
def t5_vitals_in_steps(spark, sf_dir):
    return rounded(temporal.vitals(derived.series(spark, sf_dir), longest=64), 4)


@query(_VITALS.replace("capture_id, count(*) AS n", "capture_id, 0 AS n").replace("v AS (", "v0 AS (", 1).split("\nc AS")[0] + f"""
v AS (SELECT capture_id, frame // 32 AS window_idx, frame % 32 AS frame, signal FROM v0 QUALIFY count(*) OVER (PARTITION BY capture_id, frame // 32) = 32),
s AS (SELECT capture_id, window_idx, frame, (signal - avg(signal) OVER (PARTITION BY capture_id, window_idx)) * {hann('frame', 32)} AS x FROM v)
SELECT capture_id, window_idx, round(sum(a), 4) AS energy FROM (SELECT capture_id, window_idx, k, sqrt(sum(x * cos({PI2!r} * ((k * frame) % 32) / 32)) ** 2 + sum(x * sin({PI2!r} * ((k * frame) % 32) / 32)) ** 2) AS a FROM s, range(17) t(k) WHERE (k * 15.0 / 32 >= 0.6 AND k * 15.0 / 32 < 0.8) OR k * 15.0 / 32 > 3.5 GROUP BY ALL) GROUP BY ALL""")
def t7_band_energy_by_window(spark, sf_dir):
    return _longs(rounded(temporal.band_energy_by_window(derived.series(spark, sf_dir)), 4))


@query(parts("e", "es", "ew", "ef", last=f"""SELECT rx, t, round((p + {PI2!r} * sum(turn) OVER (PARTITION BY rx ORDER BY t)) * {workflows.wavelength(derived.RADAR) / (4 * np.pi)!r}, 6) + 0.0 AS displacement_m FROM (
SELECT rx, t, p, CASE WHEN p - lag(p) OVER w > pi() THEN -1 WHEN p - lag(p) OVER w <= -pi() THEN 1 ELSE 0 END AS turn FROM (SELECT rx, frame * 16 + chirp AS t, atan2(im, re) AS p FROM ef WHERE k = 9) WINDOW w AS (PARTITION BY rx ORDER BY t))"""))
def t8_phase_displacement(spark, sf_dir):
    at = _spectrum(spark, sf_dir).select("capture_id", "rx", (F.col("frame").cast("long") * 16 + F.col("chirp")).alias("t"), F.get("re", F.lit(9)).alias("re"), F.get("im", F.lit(9)).alias("im"))
    return _longs(rounded(temporal.phase_displacement(at, workflows.wavelength(derived.RADAR)).drop("capture_id")))


def _windows_sql(frames: int, hop: int) -> str:
    return parts(*_RA, last=f"""SELECT w AS window_idx, k AS range_idx, a AS angle_idx, round(10 * log10(en + 1e-12) - max(10 * log10(en + 1e-12)) OVER (PARTITION BY w), 4) + 0.0 AS db FROM (
SELECT w, k, a, sum(sqrt(x * x + y * y)) AS en FROM (
SELECT w, k, a, h, sum(s * cos({PI2!r} * ((h * j) % 32) / 32)) AS x, sum(s * sin({PI2!r} * ((h * j) % 32) / 32)) AS y FROM (
SELECT w, k, a, j, (lin - avg(lin) OVER (PARTITION BY w, k, a)) * {hann('j', frames)} AS s FROM (
SELECT w, k, a, frame - w * {hop} AS j, 10 ** (db / 10) AS lin FROM ra, range(0, 1000) t(w) WHERE frame >= w * {hop} AND frame < w * {hop} + {frames} AND w * {hop} + {frames} <= (SELECT max(frame) + 1 FROM e))), range(0, 17) t(h)
WHERE (h * 15.0 / 32 >= 0.6 AND h * 15.0 / 32 < 0.8) OR h * 15.0 / 32 > 3.5 GROUP BY w, k, a, h) GROUP BY w, k, a)""")


@query(_windows_sql(6, 4))
def t7_movement_by_window(spark, sf_dir):
    return _longs(rounded(workflows.movement_by_window(derived.complex_cube(spark, sf_dir), derived.RADAR, 2, 32, 6, 4).drop("capture_id"), 4))


@query(_windows_sql(4, 5))
def t7_movement_by_window_apart(spark, sf_dir):
    return _longs(rounded(workflows.movement_by_window(derived.complex_cube(spark, sf_dir), derived.RADAR, 2, 32, 4, 5).drop("capture_id"), 4))


def band_pass_sql(low: float, high: str, fps: str, half: str) -> str:
    """Coefficient j of a band-pass filter."""
    side = lambda f: f"CASE WHEN j = 0 THEN 2.0 * {f} / {fps} ELSE sin({PI2!r} * {f} * j / {fps}) / ({np.pi!r} * j) END"
    return f"({side(high)} - {side(str(low))}) * (0.54 + 0.46 * cos({np.pi!r} * j / {half}))"


_DISPLACED = ("e", "es", "ew", "ef")
_BANDS = f"""dp AS (SELECT rx, t, (p + {PI2!r} * sum(turn) OVER (PARTITION BY rx ORDER BY t)) * {workflows.wavelength(derived.RADAR) / (4 * np.pi)!r} AS x FROM (
SELECT rx, t, p, CASE WHEN p - lag(p) OVER w > pi() THEN -1 WHEN p - lag(p) OVER w <= -pi() THEN 1 ELSE 0 END AS turn FROM (SELECT rx, frame AS t, atan2(im, re) AS p FROM ef WHERE k = 9 AND chirp = 0) WINDOW w AS (PARTITION BY rx ORDER BY t))),
bp AS (SELECT d.rx, d.t, sum(x.x * {band_pass_sql(0.1, '0.6', '15.0', '8')}) AS breathing_m, sum(x.x * {band_pass_sql(0.8, '3.5', '15.0', '8')}) AS heart_m
  FROM dp d, range(-8, 9) r(j), dp x WHERE x.rx = d.rx AND x.t = greatest(0, least((SELECT max(t) FROM dp), d.t - j)) GROUP BY d.rx, d.t)"""


def _displacement(spark, sf_dir):
    at = _spectrum(spark, sf_dir).where("chirp = 0").select("capture_id", "rx", F.col("frame").cast("long").alias("t"), F.get("re", F.lit(9)).alias("re"), F.get("im", F.lit(9)).alias("im"))
    return temporal.phase_displacement(at, workflows.wavelength(derived.RADAR), block=8)


@query(parts(*_DISPLACED, last="").rstrip() + f",\n{_BANDS} SELECT rx, t, round(breathing_m, 9) + 0.0 AS breathing_m, round(heart_m, 9) + 0.0 AS heart_m FROM bp")
def t8_displacement_bands(spark, sf_dir):
    return _longs(rounded(temporal.displacement_bands(_displacement(spark, sf_dir), seconds=0.5, block=8).drop("capture_id"), 9))


@query(parts(*_DISPLACED, last="").rstrip() + f""",\n{_BANDS},
u AS (SELECT rx, 'br' AS band, t, breathing_m AS y FROM bp UNION ALL SELECT rx, 'hr', t, heart_m FROM bp),
n AS (SELECT max(t) + 1 AS n, CAST(2 ** ceil(log2(greatest(32, max(t) + 1))) AS BIGINT) AS nf FROM dp),
s AS (SELECT rx, band, t, nf, (y - avg(y) OVER (PARTITION BY rx, band)) * (0.5 - 0.5 * cos({PI2!r} * t / (n - 1))) AS y FROM u, n),
f AS (SELECT rx, band, k, k * 15.0 / nf AS hz, sqrt(sum(y * cos({PI2!r} * ((k * t) % nf) / nf)) ** 2 + sum(y * sin({PI2!r} * ((k * t) % nf) / nf)) ** 2) AS a FROM s, range(0, 4096) t(k) WHERE k <= nf // 2 GROUP BY rx, band, k, nf),
r AS (SELECT rx, coalesce(max_by(hz, a) FILTER (band = 'br' AND hz >= 0.1 AND hz <= 0.6), 0) AS br, coalesce(max_by(hz, a) FILTER (band = 'hr' AND hz >= 0.8 AND hz <= 3.5), 0) AS hr FROM f GROUP BY rx)
SELECT rx, round(br, 4) AS br_hz, round(60 * br, 4) AS br_bpm, round(hr, 4) AS hr_hz, round(60 * hr, 4) AS hr_bpm FROM r""")
def t8_displacement_rates(spark, sf_dir):
    return _longs(rounded(temporal.displacement_rates(_displacement(spark, sf_dir), seconds=0.5, block=8, longest=16).drop("capture_id"), 4))


# ---------------------------------------------------------------- detection


def _box(half: int) -> str:
    return f"sum(mag) OVER (PARTITION BY frame ORDER BY d RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)"


def _cfar_sql(guard: int, train: int, factor: float, noise: str) -> str:
    w = guard + train
    return f"""SELECT x.frame, x.d, x.r, any_value(x.mag) AS mag, {noise}(y.mag) AS noise FROM m x JOIN m y ON x.frame = y.frame AND abs(x.d - y.d) <= {w} AND abs(x.r - y.r) <= {w} AND (abs(x.d - y.d) > {guard} OR abs(x.r - y.r) > {guard})
WHERE x.d BETWEEN {w} AND (SELECT max(d) FROM m) - {w} AND x.r BETWEEN {w} AND (SELECT max(r) FROM m) - {w} GROUP BY x.frame, x.d, x.r"""


_G = "m AS (" + COMMON["g"] + ")"


@query(f"WITH {_G} SELECT frame, d AS doppler_idx, r AS range_idx, round(mag, 6) AS mag, round(noise, 6) AS noise, mag > noise * 1.8 AS hit FROM ({_cfar_sql(1, 2, 1.8, 'avg')})")
def x1_cfar(spark, sf_dir):
    return _longs(rounded(detection.cfar_columns(derived.grid(spark, sf_dir), 1, 2, 1.8).drop("capture_id")))


def _hits_sql(noise: str) -> str:
    """Hits with the least cell number of their group, by spreading labels until nothing changes."""
    return f"""WITH RECURSIVE {_G}, h AS (SELECT frame, d, r, mag FROM ({_cfar_sql(1, 2, 1.8, noise)}) WHERE mag > noise * 1.8),
reach AS (SELECT frame, d, r, d * 32 + r AS root FROM h UNION SELECT h.frame, h.d, h.r, reach.root FROM reach JOIN h ON h.frame = reach.frame AND abs(h.d - reach.d) + abs(h.r - reach.r) = 1),
l AS (SELECT frame, d, r, min(root) AS root FROM reach GROUP BY frame, d, r),
n AS (SELECT l.frame, l.d, l.r, h.mag, dense_rank() OVER (PARTITION BY l.frame ORDER BY root) AS label FROM l JOIN h USING (frame, d, r))"""


def _grid_rows(spark, sf_dir) -> DataFrame:
    rows = derived.grid(spark, sf_dir).groupBy("capture_id", "frame", "doppler_idx").agg(F.array_sort(F.collect_list(F.struct("range_idx", "mag"))).alias("x"))
    return rows.select("capture_id", "frame", "doppler_idx", F.col("x.mag").alias("mag"))


@query(_hits_sql("avg") + "SELECT frame, d AS doppler_idx, r AS range_idx, round(mag, 6) AS mag, label FROM n")
def x4_clusters(spark, sf_dir):
    return _longs(rounded(detection.cfar(_grid_rows(spark, sf_dir), 1, 2, 1.8).drop("capture_id")))


@query(_hits_sql("avg") + "SELECT frame, d AS doppler_idx, r AS range_idx, round(mag, 6) AS mag, label FROM n")
def x4_clusters_in_tiles(spark, sf_dir):
    return _longs(rounded(tiles.cfar(derived.grid(spark, sf_dir), 1, 2, 1.8, tile=(5, 7)).drop("capture_id")))


@query(_hits_sql("median") + "SELECT frame, d AS doppler_idx, r AS range_idx, round(mag, 6) AS mag, label FROM n")
def x2_ordered_cfar(spark, sf_dir):
    return _longs(rounded(detection.cfar(_grid_rows(spark, sf_dir), 1, 2, 1.8, "ordered").drop("capture_id")))


@query(_hits_sql("avg") + f"""SELECT frame, label, d AS doppler_idx, r AS range_idx, round(mag, 6) AS magnitude, round(r * {STEP!r}, 6) AS range_m, round((d - 8) * {V_STEP!r}, 6) + 0.0 AS velocity_ms
FROM n QUALIFY row_number() OVER (PARTITION BY frame, label ORDER BY mag DESC, d, r) = 1""")
def x5_peaks(spark, sf_dir):
    found = detection.peaks(detection.cfar(_grid_rows(spark, sf_dir), 1, 2, 1.8))
    return _longs(rounded(detection.to_targets(found, 32, STEP, 16, V_STEP).drop("capture_id")))


@query(parts("v", last="""SELECT capture_id, frame, round(signal, 6) AS signal, round(noise, 6) AS noise, signal > noise * 1.5 AS hit, round(CASE WHEN noise > 0 THEN 20 * log10(signal / noise) ELSE 0 END, 4) + 0.0 AS snr_db FROM (
SELECT *, (sum(signal) OVER a + sum(signal) OVER b) / 16 AS noise FROM v WINDOW a AS (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING), b AS (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN 3 FOLLOWING AND 10 FOLLOWING)
QUALIFY count(*) OVER a = 8 AND count(*) OVER b = 8)"""))
def x3_cfar_line(spark, sf_dir):
    rows = detection.cfar_line(derived.series(spark, sf_dir), ["capture_id"], "frame", "signal", factor=1.5)
    return _longs(rounded(rows.withColumn("snr_db", F.round(detection.snr_db(F.col("signal"), F.col("noise")), 4))))


_TARGETS = f"""WITH RECURSIVE {", ".join(f"{n} AS ({COMMON[n]})" for n in (*_DZ, "rd"))}, m AS (SELECT frame, d, k AS r, mag FROM rd),
h AS (SELECT frame, d, r, mag FROM ({_cfar_sql(1, 1, 1.5, 'avg')}) WHERE mag > noise * 1.5),
reach AS (SELECT frame, d, r, d * 32 + r AS root FROM h UNION SELECT h.frame, h.d, h.r, reach.root FROM reach JOIN h ON h.frame = reach.frame AND abs(h.d - reach.d) + abs(h.r - reach.r) = 1),
l AS (SELECT frame, d, r, min(root) AS root FROM reach GROUP BY frame, d, r),
n AS (SELECT l.frame, l.d, l.r, h.mag, dense_rank() OVER (PARTITION BY l.frame ORDER BY root) AS label FROM l JOIN h USING (frame, d, r))
SELECT frame, label, d AS doppler_idx, r AS range_idx, round(mag, 6) AS magnitude, round(r * {STEP!r}, 6) AS range_m, round((d - 4) * {V_STEP!r}, 6) + 0.0 AS velocity_ms
FROM n QUALIFY row_number() OVER (PARTITION BY frame, label ORDER BY mag DESC, d, r) = 1"""


@query(_TARGETS)
def x8_targets(spark, sf_dir):
    found = workflows.targets(derived.complex_cube(spark, sf_dir), derived.RADAR, 16, 32, 1, 1, 1.5)
    return _longs(rounded(found.drop("capture_id")))


_SIGNAL = "SELECT 'E' AS capture_id, frame, avg(mag) AS signal FROM rd WHERE k BETWEEN 4 AND 16 GROUP BY frame"


@query(parts(*_DZ, "rd", last="").rstrip() + f",\nv AS ({_SIGNAL})," + _AMPLITUDES + _SHARES)
def w3_vital_signs(spark, sf_dir):
    return rounded(workflows.vital_signs(derived.complex_cube(spark, sf_dir), derived.RADAR, 16, 32, 10, 6), 4)


# ---------------------------------------------------------------- design

_GOALS = "SELECT p_partkey AS goal_id, CAST(p_size AS DOUBLE) AS max_range_m, CAST(3 + p_partkey % 17 AS DOUBLE) AS range_res_cm, 1 + (p_partkey % 5) * 0.5::DOUBLE AS max_vel_ms, 0.05::DOUBLE * (1 + p_partkey % 4) AS vel_res_ms, CASE WHEN p_partkey % 2 = 0 THEN 60.0 ELSE 77.0 END::DOUBLE AS start_freq_ghz FROM part"


@query(f"""WITH a AS (SELECT *, {C0!r}::DOUBLE / (2 * range_res_cm / 100) / 1e6 AS bw, {C0!r}::DOUBLE / (start_freq_ghz * 1e9) AS wl FROM ({_GOALS})),
b AS (SELECT *, wl / (4 * max_vel_ms) AS t, wl / (4 * max_vel_ms) * 0.8::DOUBLE AS ramp FROM a),
c AS (SELECT *, bw * 1e6 / ramp AS slope, bw * 1e6 / ramp * 2 * max_range_m / {C0!r}::DOUBLE * 1.25::DOUBLE AS rate FROM b),
d AS (SELECT *, CASE WHEN bw / 1e3 > 4 THEN 'bandwidth' WHEN rate / 1e6 > 40 THEN 'adc_rate' END AS reason, CAST(2 ** ceil(log2(floor(rate * ramp))) AS BIGINT) AS samples, CAST(greatest(16, 2 ** ceil(log2(round_even(wl / (2 * vel_res_ms * t), 0)))) AS BIGINT) AS nd FROM c)
SELECT goal_id, reason, CASE WHEN reason IS NULL THEN round(bw, 4) END AS bandwidth_mhz, CASE WHEN reason IS NULL THEN round(slope / 1e12, 4) END AS slope_mhz_us, CASE WHEN reason IS NULL THEN samples END AS adc_samples, CASE WHEN reason IS NULL THEN nd END AS chirps, CASE WHEN reason IS NULL THEN round(nd * t * 1e3, 4) END AS frame_period_ms FROM d""")
def g1_chirp_design(spark, sf_dir):
    rows = design.parameters(derived.design_goals(spark, sf_dir))
    return _longs(rounded(rows.select("goal_id", "reason", "bandwidth_mhz", "slope_mhz_us", "adc_samples", "chirps", "frame_period_ms"), 4))
