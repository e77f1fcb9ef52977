"""Registered queries of the log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepframe.operators import logconfig
from sweepframe.plans.catalog import _longs, query, rounded
from sweepframe.sources import captures, derived

_P = derived.LOG_TIME
_TEXT = [
    ("TRUE", "'API:select_chip_version,' || CASE k % 3 WHEN 0 THEN 'IWR6843' WHEN 1 THEN 'AWR1843' ELSE 'XX9999' END"),
    ("TRUE", "'API:antPhaseRot,0.1,0.2,0.3,0.4'"),
    ("TRUE", "'API:ProfileConfig,0,' || CASE k % 3 WHEN 0 THEN 1491308088 WHEN 1 THEN 1435388860 ELSE 1541018358 END || ',1000,600,4000,0,0,1657,0,256,5000,0,0,30,0,'"),
    ("TRUE", "'API:ChirpConfig,0,0,0,0,0,0,0,1,0,'"),
    ("TRUE", "'API:ChirpConfig,1,1,0,0,0,0,0,' || CASE WHEN k % 2 = 0 THEN 4 ELSE 2 END || ',0,'"),
    ("TRUE", "'API:ChirpConfig,0,0,0,0,5,0,0,1,0,'"),
    ("TRUE", "'API:FrameConfig,0,0,' || CASE WHEN k % 4 < 3 THEN 1 ELSE 7 END || ',16,' || (8000000 + 100 * k) || ',0,' || (k % 50) || ',0,'"),
    ("TRUE", "'API:DataFmtConfig,15,2,1,' || (k % 2) || ',0,1,'"),
    ("k % 5 < 3", "'API:AdcOutConfig,2,' || (k % 4) || ',1,'"),
    ("k % 7 > 0", "'API:LaneConfig,' || (k % 16) || ','"),
    ("TRUE", "'API:LvdsLaneConfig,0,' || (1 + k % 4) || ','"),
    ("k % 2 = 0", "'API:ProfileConfig,0,1435388860,1200,600,5000,0,0,1657,0,128,6000,0,0,30,0,'"),
    ("TRUE", "'API:ProfileConfig,0,1,2'"),
    ("TRUE", "'API:antPhaseRot,9,9,9,9'"),
    ("TRUE", "'API:FrameConfig,0,0'"),
]
_LINES = "k AS (SELECT s_suppkey AS k FROM supplier), line AS (" + " UNION ALL ".join(f"SELECT CAST(k AS VARCHAR) AS capture_id, {n} AS line_no, '{_P}' || {text} AS line FROM k WHERE {there}" for n, (there, text) in enumerate(_TEXT)) + ")"
_CALLS = _LINES + r""", c AS (SELECT capture_id, line_no, regexp_extract(line, 'API:(\w+),(.*)$', 1) AS api, list_filter(string_split(regexp_extract(line, 'API:(\w+),(.*)$', 2), ','), lambda t: trim(t) <> '') AS tokens FROM line)"""
_NEED = "CASE api " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in logconfig.ENOUGH.items()) + " ELSE 1 END"
_LAST = _CALLS + f", z AS (SELECT capture_id, api, count(*) AS n, arg_max(list_transform(tokens, lambda t: TRY_CAST(t AS BIGINT)), line_no) AS v, max(line_no) AS line_no FROM c WHERE len(tokens) >= {_NEED} AND api NOT IN ('antPhaseRot') GROUP BY capture_id, api)"


def _lines(spark, sf_dir):
    return derived.log_lines(spark, sf_dir)


@query("WITH " + _CALLS + " SELECT capture_id, line_no, api, len(tokens) AS n, tokens[1] AS first_token, tokens[-1] AS last_token FROM c")
def l1_calls(spark, sf_dir):
    x = logconfig.calls(_lines(spark, sf_dir))
    return _longs(x.select("capture_id", "line_no", "api", F.size("tokens").alias("n"), F.get("tokens", F.lit(0)).alias("first_token"), F.element_at("tokens", -1).alias("last_token")))


@query("WITH " + _LAST + " SELECT capture_id, api, n, len(v) AS n_values, list_sum(v)::BIGINT AS total, line_no FROM z WHERE api <> 'select_chip_version'")
def l2_last_valid(spark, sf_dir):
    x = logconfig.last_valid(logconfig.calls(_lines(spark, sf_dir))).where("api != 'select_chip_version'")
    return _longs(x.select("capture_id", "api", "n", F.size("values").alias("n_values"), F.aggregate("values", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"), "line_no"))


@query("WITH " + _CALLS + " SELECT capture_id, api, round(list_sum(arg_min(list_transform(tokens, lambda t: CAST(t AS DOUBLE)), line_no)), 6) AS total FROM c WHERE api = 'antPhaseRot' GROUP BY capture_id, api")
def l3_first_line(spark, sf_dir):
    x = logconfig.first_line(logconfig.calls(_lines(spark, sf_dir)))
    return rounded(x.select("capture_id", "api", F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total")))


_CAPS = "WITH " + _LAST + """,
w AS (SELECT capture_id, any_value(v) FILTER (api = 'ProfileConfig') AS p, any_value(n) FILTER (api = 'ProfileConfig') AS profiles_found, any_value(v) FILTER (api = 'DataFmtConfig') AS f, any_value(v) FILTER (api = 'AdcOutConfig') AS o,
  any_value(v) FILTER (api = 'FrameConfig') AS fr, any_value(v) FILTER (api = 'LaneConfig') AS la, any_value(v) FILTER (api = 'LvdsLaneConfig') AS lv FROM z GROUP BY capture_id),
h AS (SELECT capture_id, tokens[1] AS chip, CASE WHEN tokens[1] LIKE '%6843%' OR tokens[1] LIKE '%68XX%' THEN '60' WHEN regexp_matches(tokens[1], '1642|1843|1443|16XX|18XX') THEN '77' END AS hint FROM c WHERE api = 'select_chip_version'),
b AS (SELECT *, coalesce(hint, CASE WHEN p[2] / 67108864.0::DOUBLE * 3.6 BETWEEN 74 AND 82 THEN '77' WHEN p[2] / 67108864.0::DOUBLE * 2.7 BETWEEN 57 AND 64 THEN '60' ELSE '77' END) AS band FROM w JOIN h USING (capture_id)),
a AS (SELECT *, p[2] / 67108864.0::DOUBLE * CASE band WHEN '77' THEN 3.6::DOUBLE ELSE 2.7::DOUBLE END AS start_freq_ghz, p[8] * CASE band WHEN '77' THEN 0.048279762268::DOUBLE ELSE 0.036209821701::DOUBLE END AS slope_mhz_us,
  p[3] / 100.0::DOUBLE AS idle_us, p[4] / 100.0::DOUBLE AS adc_start_us, p[5] / 100.0::DOUBLE AS ramp_us, p[10] AS num_samples, p[11] / 1000.0::DOUBLE AS fs_mhz FROM b),
d AS (SELECT *, slope_mhz_us * ramp_us * 1e-3 AS bandwidth_ghz, least(greatest(0.0, ramp_us - adc_start_us), num_samples / fs_mhz) AS eff_window_us FROM a),
x AS (SELECT *, slope_mhz_us * eff_window_us / 1000 AS eff_bandwidth_ghz, CASE WHEN o IS NOT NULL THEN CASE o[2] WHEN 0 THEN 'Real' WHEN 1 THEN 'Complex1X' WHEN 2 THEN 'Complex2X' WHEN 3 THEN 'PseudoReal' END ELSE 'Complex1X' END AS adc_fmt,
  CASE f[4] WHEN 1 THEN 'QI' ELSE 'IQ' END AS iq_order, bit_count(la[1]) AS bits, CASE lv[2] WHEN 3 THEN 4 ELSE lv[2] END AS lvds, fr[3] - fr[2] + 1 AS frame_unique FROM d)
"""


@query(_CAPS + """SELECT capture_id, chip, band, profiles_found, round(start_freq_ghz, 6) AS start_freq_ghz, round(slope_mhz_us, 6) AS slope_mhz_us, idle_us, adc_start_us, ramp_us, num_samples, fs_mhz, round(bandwidth_ghz, 6) AS bandwidth_ghz,
round(start_freq_ghz + bandwidth_ghz, 6) AS stop_freq_ghz, round(3e8 / (2 * bandwidth_ghz * 1e9), 6) AS range_res_m, round(3e8 / (2 * start_freq_ghz * 1e9 * (ramp_us * 1e-6)), 6) AS velocity_res_ms FROM x""")
def l4_profile(spark, sf_dir):
    x = logconfig.captures(_lines(spark, sf_dir))
    return rounded(x.select("capture_id", "chip", "band", "profiles_found", "start_freq_ghz", "slope_mhz_us", "idle_us", "adc_start_us", "ramp_us", "num_samples", "fs_mhz", "bandwidth_ghz", "stop_freq_ghz", "range_res_m", "velocity_res_ms"))


@query(_CAPS + """SELECT capture_id, round(eff_window_us, 6) AS eff_window_us, round(eff_bandwidth_ghz, 6) AS eff_bandwidth_ghz, round(3e8 / (2 * eff_bandwidth_ghz * 1e9), 6) AS eff_range_res_m, round(start_freq_ghz + slope_mhz_us * adc_start_us / 1000, 6) AS eff_start_ghz,
round(CASE WHEN adc_fmt LIKE 'Complex%' THEN 3e8 * fs_mhz / (2 * slope_mhz_us * (fs_mhz * eff_window_us)) END, 6) AS range_res_from_fs_m, round(3e8 / (2 * eff_bandwidth_ghz * 1e9) * 1.62, 6) AS range_res_windowed_m, round(3e8 / (2 * eff_bandwidth_ghz * 1e9) * 1.4, 6) AS range_res_hamming_m, round(3e8 / (2 * eff_bandwidth_ghz * 1e9) * 1.97, 6) AS range_res_blackman_m, round(3e8 / (2 * eff_bandwidth_ghz * 1e9), 6) AS padded_bin_m,
round(3e8 * fs_mhz * 1e6 / (4 * slope_mhz_us * 1e12), 6) AS max_range_half_m, CASE WHEN adc_fmt LIKE 'Complex%' THEN 256 ELSE 129 END AS range_bins_256 FROM x""")
def l9_effective(spark, sf_dir):
    x = logconfig.captures(_lines(spark, sf_dir))
    return _longs(rounded(x.select("capture_id", "eff_window_us", "eff_bandwidth_ghz", "eff_range_res_m", "eff_start_ghz", "range_res_from_fs_m", "range_res_windowed_m", "range_res_hamming_m", "range_res_blackman_m", "padded_bin_m", "max_range_half_m", "range_bins_256")))


@query(_CAPS + """SELECT capture_id, 16 AS adc_bits, adc_fmt, iq_order, CASE adc_fmt WHEN 'Complex2X' THEN iq_order || iq_order END AS iq_order_2x, TRUE AS interleaved, CASE WHEN bits BETWEEN 1 AND 4 THEN bits ELSE lvds END AS num_lanes,
CASE WHEN bits BETWEEN 1 AND 4 THEN 'LaneConfig' ELSE 'LvdsLaneConfig' END AS lanes_source FROM x""")
def l11_data_format(spark, sf_dir):
    x = logconfig.captures(_lines(spark, sf_dir))
    return _longs(x.select("capture_id", "adc_bits", "adc_fmt", "iq_order", "iq_order_2x", "interleaved", F.col("num_lanes").cast("int").alias("num_lanes"), "lanes_source"))


@query(_CAPS + """SELECT capture_id, fr[4] AS loops, round(fr[5] * 5.0::DOUBLE / 1000 / 1000, 6) AS frame_period_ms, fr[7] AS num_frames, frame_unique, 2 AS unique_chirps, frame_unique <> 2 AS unique_mismatch, 2 * fr[4] AS chirps_per_frame, CASE fr[7] WHEN 0 THEN 1 ELSE fr[7] END AS frames, 4 AS num_rx,
2 * fr[4] * 4 * num_samples * CASE WHEN adc_fmt IN ('Complex1X', 'Complex2X') THEN 2 ELSE 1 END AS words_per_frame, round(1000 / (fr[5] * 5.0::DOUBLE / 1000 / 1000), 6) AS fps, CAST(round_even(fr[5] * 5.0::DOUBLE / 1000 / 1000, 0) AS INT) AS period_ms FROM x""")
def l15_frame_and_dimensions(spark, sf_dir):
    x = logconfig.captures(_lines(spark, sf_dir))
    return _longs(rounded(x.select("capture_id", "loops", "frame_period_ms", "num_frames", "frame_unique", "unique_chirps", "unique_mismatch", "chirps_per_frame", "frames", "num_rx", "words_per_frame", "fps", "period_ms")))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS capture_id, c AS first, c AS last, CASE c WHEN 0 THEN 5 ELSE 0 END AS slope_var, CASE c WHEN 0 THEN 1 ELSE CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 2 END END AS tx_enable FROM supplier, range(2) t(c)")
def l12_chirps(spark, sf_dir):
    return logconfig.chirps(_lines(spark, sf_dir)).select("capture_id", "first", "last", "slope_var", "tx_enable")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS capture_id, c AS pos, CASE c WHEN 0 THEN 1 ELSE CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 2 END END AS tx_mask, CASE c WHEN 0 THEN 'TX0' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'TX2' ELSE 'TX1' END END AS tx_name FROM supplier, range(2) t(c)")
def l13_positions(spark, sf_dir):
    return _longs(logconfig.positions(logconfig.chirps(_lines(spark, sf_dir))))


@query(_CAPS + """SELECT capture_id, c AS first, CASE c WHEN 0 THEN 'TX0' ELSE CASE WHEN CAST(capture_id AS BIGINT) % 2 = 0 THEN 'TX2' ELSE 'TX1' END END AS tx_active, round((p[8] + CASE c WHEN 0 THEN 5 ELSE 0 END) * s, 6) AS eff_slope, round(eff_window_us, 6) AS eff_window_us,
round((p[8] + CASE c WHEN 0 THEN 5 ELSE 0 END) * s * eff_window_us, 6) AS eff_bandwidth_mhz, round(start_freq_ghz + (p[8] + CASE c WHEN 0 THEN 5 ELSE 0 END) * s * adc_start_us / 1000, 6) AS eff_start_ghz
FROM (SELECT *, CASE band WHEN '77' THEN 0.048279762268::DOUBLE ELSE 0.036209821701::DOUBLE END AS s FROM x), range(2) t(c)""")
def l19_chirp_values(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    x = logconfig.chirp_values(logconfig.captures(lines), logconfig.chirps(lines))
    return rounded(x.select("capture_id", "first", "tx_active", "eff_slope", "eff_window_us", "eff_bandwidth_mhz", "eff_start_ghz"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS capture_id, CASE c WHEN 0 THEN 'TX0' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'TX2' ELSE 'TX1' END END AS tx_name, c AS first_pos FROM supplier, range(2) t(c)")
def l22_selectable_tx(spark, sf_dir):
    return _longs(logconfig.selectable_tx(logconfig.positions(logconfig.chirps(_lines(spark, sf_dir)))).drop("tx_positions"))


_TX = "CASE WHEN CAST(capture_id AS BIGINT) % 2 = 0 THEN 'TX2' ELSE 'TX1' END"
_FRES = "3e8 / (2 * eff_bandwidth_ghz * 1e9)"
#: The parameters by group, spelled out: number, group, name, SQL of a number or (quoted kinds) of a text.
_GROUPED = [
    *[(i, "General", n, e, t) for i, (n, e, t) in enumerate([("profiles_found", "profiles_found", 0), ("chip", "chip", 1), ("chip_band", "hint", 0), ("band", "band", 0), ("start_freq_ghz", "start_freq_ghz", 0), ("eff_start_ghz", "start_freq_ghz + slope_mhz_us * adc_start_us / 1000", 0), ("stop_freq_ghz", "start_freq_ghz + bandwidth_ghz", 0), ("slope_const", "p[8]", 0), ("slope_mhz_us", "slope_mhz_us", 0), ("idle_us", "idle_us", 0), ("adc_start_us", "adc_start_us", 0), ("tx_start_us", "p[9] / 100", 0), ("ramp_us", "ramp_us", 0), ("num_samples", "num_samples", 0), ("fs_mhz", "fs_mhz", 0)])],
    *[(100 + i, "Bandwidth & Resolution", n, e, 0) for i, (n, e) in enumerate([("bandwidth_ghz", "bandwidth_ghz"), ("eff_bandwidth_ghz", "eff_bandwidth_ghz"), ("range_res_m", "3e8 / (2 * bandwidth_ghz * 1e9)"), ("eff_range_res_m", _FRES), ("range_res_windowed_m", _FRES + " * 1.62"), ("sample_time_us", "num_samples / fs_mhz"), ("ramp_window_us", "greatest(0.0, ramp_us - adc_start_us)"), ("eff_window_us", "eff_window_us")])],
    *[(200 + i, "Data Format", n, e, t) for i, (n, e, t) in enumerate([("adc_fmt", "adc_fmt", 1), ("adc_bits", "16", 0), ("iq_order", "iq_order", 1), ("rx_mask", "15", 0), ("num_rx", "4", 0), ("interleaved", "'true'", 1), ("num_lanes", "CASE WHEN bits BETWEEN 1 AND 4 THEN bits ELSE lvds END", 0), ("lanes_source", "CASE WHEN bits BETWEEN 1 AND 4 THEN 'LaneConfig' ELSE 'LvdsLaneConfig' END", 1)])],
    (300, "RX/TX & Gains", "rx_gain", "p[14]", 0), (301, "RX/TX & Gains", "tx_backoff", "p[6]", 0), (302, "RX/TX & Gains", "tx_phase", "p[7]", 0),
    (400, "Frame (derived/log)", "frame_period_ms", "fr[5] * 5.0::DOUBLE / 1000 / 1000", 0), (401, "Frame (derived/log)", "unique_chirps", "2", 0), (402, "Frame (derived/log)", "frame_unique", "frame_unique", 0), (403, "Frame (derived/log)", "unique_mismatch", "CASE WHEN frame_unique <> 2 THEN 'true' ELSE 'false' END", 1),
    *[(500 + i, "FrameConfig", n, e, 0) for i, (n, e) in enumerate([("chirp_start", "fr[2]"), ("chirp_end", "fr[3]"), ("frame_unique", "frame_unique"), ("loops", "fr[4]"), ("chirps_per_frame", "2 * fr[4]"), ("num_frames", "fr[7]"), ("frame_period_ms", "fr[5] * 5.0::DOUBLE / 1000 / 1000")])],
    (600, "Chirp TX Pattern", "order", f"'TX0 | ' || {_TX}", 1), (601, "Chirp TX Pattern", "active", f"'TX0, ' || {_TX}", 1), (602, "Chirp TX Pattern", "pattern_len", "2", 0), (603, "Chirp TX Pattern", "positions", f"'TX0: 0 | ' || {_TX} || ': 1'", 1),
    *[(700 + 100 * c + i, f"Chirp {c}-{c} (prof 0)", n, e, t) for c in (0, 1) for i, (n, e, t) in enumerate([("tx_enable", "1" if c == 0 else f"CASE {_TX} WHEN 'TX2' THEN 4 ELSE 2 END", 0), ("tx_active", "'TX0'" if c == 0 else _TX, 1), ("start_var", "0", 0), ("slope_var", "0" if c else "5", 0), ("idle_var", "0", 0), ("adc_start_var", "0", 0)])],
]
_ITEMS = ", ".join(f"struct_pack(ord := {o}, param_group := '{g}', name := '{n}', number := {'NULL' if t else f'CAST({e} AS DOUBLE)'}, body := {e if t else 'NULL'})" for o, g, n, e, t in _GROUPED)


@query(_CAPS + f"SELECT capture_id, q.ord AS ord, q.param_group AS param_group, q.name AS name, round(q.number, 4) AS number, q.body AS body FROM (SELECT capture_id, unnest([{_ITEMS}]) AS q FROM x) WHERE q.number IS NOT NULL OR q.body IS NOT NULL")
def s5_grouped_view(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    x = logconfig.grouped_view(logconfig.captures(lines), logconfig.chirps(lines))
    number = F.col("value").try_cast("double")
    return _longs(rounded(x.where("name != 'bpf'").select("capture_id", "ord", "param_group", "name", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("body")), 4))
