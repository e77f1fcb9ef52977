"""From text logs to one row of parameters for each capture, in column functions.

Of the lines of one call the last valid one wins (the first one for
calibration); a line is valid if it has enough values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.functions.signal import next_pow2

#: Values that a line must have.
ENOUGH = {"ProfileConfig": 11, "DataFmtConfig": 6, "AdcOutConfig": 3, "ChirpConfig": 8, "FrameConfig": 8, "AdvancedFrameConfig": 5, "LaneConfig": 1, "LvdsLaneConfig": 2}
FIRST_WINS = ("antGeometry0", "antGeometry1", "compRangeBiasAndRxChanPhase", "antPhaseRot", "DataPathConfig")
#: GHz of 2^26 start units, MHz/us of a slope unit by band, broadening of a window.
START_GHZ = {"77": 3.6, "60": 2.7}
SLOPE_LSB = {"77": 0.048279762268, "60": 0.036209821701}
BROADENING = {"hann": 1.62, "hamming": 1.4, "blackman": 1.97}
C = 3e8


def calls(lines: DataFrame) -> DataFrame:
    """(capture_id, line_no, line) -> (capture_id, line_no, stamp, api, tokens): blank values are dropped."""
    pattern = r"API:(\w+),(.*)$"
    parts = lines.select("capture_id", "line_no", F.regexp_extract("line", pattern, 1).alias("api"), F.regexp_extract("line", pattern, 2).alias("rest"), F.regexp_extract("line", r"^(\d{2}-\w{3}-\d{4} \d{2}:\d{2}:\d{2})", 1).alias("at"))
    tokens = F.filter(F.split("rest", ","), lambda t: F.trim(t) != "")
    return parts.where("api != ''").select("capture_id", "line_no", F.try_to_timestamp("at", F.lit("dd-MMM-yyyy HH:mm:ss")).alias("stamp"), "api", F.transform(tokens, lambda t: F.trim(t)).alias("tokens"))


def ints(tokens: Column) -> Column:
    """Values as integers, null where one isn't a number."""
    return F.transform(tokens, lambda t: t.try_cast("bigint"))


def _least() -> Column:
    need = F.coalesce(*[F.when(F.col("api") == k, F.lit(v)) for k, v in ENOUGH.items()], F.lit(1))
    return F.size("tokens") >= need


def last_valid(found: DataFrame) -> DataFrame:
    """(capture_id, api, n, values, line_no) of the last valid line of each call; n counts the valid ones."""
    valid = found.where(_least() & ~F.col("api").isin(*FIRST_WINS))
    return valid.groupBy("capture_id", "api").agg(F.count(F.lit(1)).alias("n"), F.max_by(ints(F.col("tokens")), "line_no").alias("values"), F.max("line_no").alias("line_no"))


def first_line(found: DataFrame) -> DataFrame:
    """(capture_id, api, values as doubles) of the first line of the calibration calls."""
    rows = found.where(F.col("api").isin(*FIRST_WINS))
    return rows.groupBy("capture_id", "api").agg(F.min_by(F.transform("tokens", lambda t: t.try_cast("double")), "line_no").alias("values"))


def chip_band(chip: Column) -> Column:
    """The band of a chip name; null if it names none. XX stands for any device of a family."""
    return F.when(F.upper(chip).rlike("6843|68XX"), F.lit("60")).when(F.upper(chip).rlike("1642|1843|1443|16XX|18XX"), F.lit("77"))


def chips(found: DataFrame) -> DataFrame:
    """(capture_id, chip, chip_band): the first chip line that names a band, else the last chip line."""
    rows = found.where("api = 'select_chip_version'").withColumn("chip", F.get("tokens", F.lit(0))).withColumn("band", chip_band(F.col("chip")))
    named = rows.groupBy("capture_id").agg(F.min_by(F.when(F.col("band").isNotNull(), F.struct("chip", "band")), F.when(F.col("band").isNotNull(), F.col("line_no"))).alias("hit"), F.max_by("chip", "line_no").alias("last"))
    return named.select("capture_id", F.coalesce("hit.chip", "last").alias("chip"), F.col("hit.band").alias("chip_band"))


def start_ghz(const: Column, band: str) -> Column:
    return const / F.lit(float(1 << 26)) * F.lit(START_GHZ[band])


def infer_band(const: Column, hint: Column) -> Column:
    """The chip's band; else 77 if the start frequency is in 74 to 82 GHz as that band counts, 60 if in 57 to 64 as that one does, else 77."""
    inferred = F.when(start_ghz(const, "77").between(74, 82), F.lit("77")).when(start_ghz(const, "60").between(57, 64), F.lit("60")).otherwise(F.lit("77"))
    return F.coalesce(hint, inferred)


def _calls_wide(found: DataFrame) -> DataFrame:
    """One row for each capture: a column of values for each call."""
    wide = last_valid(found).groupBy("capture_id").agg(*[F.max_by("values", F.when(F.col("api") == a, 1)).alias(a) for a in ENOUGH], F.max(F.when(F.col("api") == "ProfileConfig", F.col("n"))).alias("profiles_found"))
    fixed = first_line(found).groupBy("capture_id").agg(*[F.max_by("values", F.when(F.col("api") == a, 1)).alias(a) for a in FIRST_WINS])
    return wide.join(fixed, "capture_id", "left").join(chips(found), "capture_id", "left")


PROFILE = ["profile_id", "start_freq_const", "idle_const", "adc_start_const", "ramp_end_const", "tx_backoff", "tx_phase", "slope_const", "tx_start_const", "num_samples", "rate_ksps", "hpf1", "hpf2", "rx_gain"]


def bits_of(code: Column) -> Column:
    return F.when(code == 0, 12).when(code == 1, 14).otherwise(16)


def captures(lines: DataFrame) -> DataFrame:
    """The parameters of every capture that has a valid profile."""
    at = lambda api, i: F.get(api, F.lit(i))
    x = _calls_wide(calls(lines)).where("ProfileConfig is not null")
    x = x.withColumns({name: at("ProfileConfig", i) for i, name in enumerate(PROFILE)})
    x = x.withColumn("band", infer_band(F.col("start_freq_const"), F.col("chip_band")))
    by_band = lambda c, table: F.when(F.col("band") == "77", c * F.lit(table["77"])).otherwise(c * F.lit(table["60"]))
    x = x.withColumns({
        "start_freq_ghz": by_band(F.col("start_freq_const") / F.lit(float(1 << 26)), START_GHZ), "slope_mhz_us": F.coalesce(by_band(F.col("slope_const"), SLOPE_LSB), F.lit(0.0)),
        "idle_us": F.col("idle_const") / 100, "adc_start_us": F.col("adc_start_const") / 100, "ramp_us": F.col("ramp_end_const") / 100, "tx_start_us": F.col("tx_start_const") / 100,
        "fs_mhz": F.when(F.col("rate_ksps") != 0, F.col("rate_ksps") / 1000),
    })
    known = (F.col("start_freq_ghz") != 0) & (F.col("slope_mhz_us") != 0) & (F.col("ramp_us") != 0)
    x = x.withColumn("bandwidth_ghz", F.when(known, F.col("slope_mhz_us") * F.col("ramp_us") * 1e-3))
    x = x.withColumns({
        "stop_freq_ghz": F.col("start_freq_ghz") + F.col("bandwidth_ghz"), "range_res_m": F.when(F.col("bandwidth_ghz") > 0, C / (2 * F.col("bandwidth_ghz") * 1e9)),
        "velocity_res_ms": F.when((F.col("start_freq_ghz") != 0) & (F.col("ramp_us") != 0), C / (2 * F.col("start_freq_ghz") * 1e9 * (F.col("ramp_us") * 1e-6))),
        "sample_time_us": F.when((F.col("num_samples") != 0) & (F.col("fs_mhz") > 0), F.col("num_samples") / F.col("fs_mhz")),
        "ramp_window_us": F.greatest(F.lit(0.0), F.col("ramp_us") - F.coalesce("adc_start_us", F.lit(0.0))),
    })
    # least() skips a missing sample time
    x = x.withColumn("eff_window_us", F.when(F.col("ramp_us").isNotNull(), F.least("ramp_window_us", "sample_time_us")))
    x = x.withColumn("eff_bandwidth_ghz", F.col("slope_mhz_us") * F.col("eff_window_us") / 1000)
    x = x.withColumns({"eff_range_res_m": F.when(F.col("eff_bandwidth_ghz") > 0, C / (2 * F.col("eff_bandwidth_ghz") * 1e9)), "eff_start_ghz": F.col("start_freq_ghz") + F.col("slope_mhz_us") * F.coalesce("adc_start_us", F.lit(0.0)) / 1000})

    fmt, out = (lambda i: at("DataFmtConfig", i)), (lambda i: at("AdcOutConfig", i))
    simple = F.when(fmt(2) == 1, F.lit("Complex1X")).otherwise(F.when(F.col("DataFmtConfig").isNotNull(), F.lit("Real")))
    detailed = F.when(out(1) == 0, F.lit("Real")).when(out(1) == 1, F.lit("Complex1X")).when(out(1) == 2, F.lit("Complex2X")).when(out(1) == 3, F.lit("PseudoReal")).otherwise(F.concat(F.lit("UNK("), out(1).cast("string"), F.lit(")")))
    x = x.withColumns({
        "rx_mask": fmt(0), "adc_bits": F.coalesce(F.when(F.col("AdcOutConfig").isNotNull(), bits_of(out(0))), F.when(F.col("DataFmtConfig").isNotNull(), bits_of(fmt(1)))),
        "adc_fmt": F.when(F.col("AdcOutConfig").isNotNull(), detailed).otherwise(simple), "iq_order": F.when(F.col("DataFmtConfig").isNotNull(), F.when(fmt(3) == 1, F.lit("QI")).otherwise(F.lit("IQ"))),
        "interleaved": F.coalesce(out(2), fmt(5)) == 1,
    })
    x = x.withColumn("iq_order_2x", F.when(F.col("adc_fmt") == "Complex2X", F.concat("iq_order", "iq_order")))

    frame = lambda i: at("FrameConfig", i)
    x = x.withColumns({
        "chirp_start": frame(1), "chirp_end": frame(2), "loops": frame(3), "frame_ticks": frame(4), "frame_period_ms": frame(4) * 5.0 / 1000 / 1000, "num_frames": frame(6),
        "frame_unique": F.when(frame(2) >= frame(1), frame(2) - frame(1) + 1),
        "adv_header": at("AdvancedFrameConfig", 0), "adv_sub_frames": at("AdvancedFrameConfig", 4), "adv_periods_us": F.filter("AdvancedFrameConfig", lambda v: v >= 100000),
    })
    lane_bits = F.bit_count(at("LaneConfig", 0)).cast("int")
    code = at("LvdsLaneConfig", 1)
    lanes, lvds = F.when(lane_bits.between(1, 4), lane_bits), F.when(code.isin(1, 2, 4), code).when(code == 3, 4).cast("int")
    x = x.withColumns({"num_lanes": F.coalesce(lanes, lvds), "lanes_source": F.when(lanes.isNotNull(), F.lit("LaneConfig")).when(lvds.isNotNull(), F.lit("LvdsLaneConfig")).otherwise(F.lit("unknown"))})
    patterns = transmit_pattern(chirps(lines))
    return with_dimensions(x.join(patterns, "capture_id", "left"))


def chirps(lines: DataFrame) -> DataFrame:
    """(capture_id, first, last, profile, start_var, slope_var, idle_var, adc_start_var, tx_enable, bpf): the last line of each (first, last, profile)."""
    names = ["first", "last", "profile", "start_var", "slope_var", "idle_var", "adc_start_var", "tx_enable", "bpf"]
    rows = calls(lines).where(F.col("api") == "ChirpConfig").where(_least()).select("capture_id", "line_no", ints(F.col("tokens")).alias("v"))
    rows = rows.select("capture_id", "line_no", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    rest = names[3:]
    best = rows.groupBy("capture_id", "first", "last", "profile").agg(F.max_by(F.struct(*rest), "line_no").alias("x"))
    return best.select("capture_id", "first", "last", "profile", *[F.col(f"x.{n}").alias(n) for n in rest])


def tx_name(mask: Column) -> Column:
    """TX0,TX2 for mask 5; None for mask 0."""
    names = F.concat_ws(",", *[F.when(F.shiftright(mask, i).bitwiseAND(F.lit(1)) == 1, F.lit(f"TX{i}")) for i in range(3)])
    return F.when(names == "", F.lit("None")).otherwise(names)


def positions(found: DataFrame) -> DataFrame:
    """(capture_id, pos, tx_mask, tx_name): the transmit pattern, chirps in order of (first, last), each range as long as it is."""
    n = F.when(F.col("last") >= F.col("first"), F.col("last") - F.col("first") + 1).otherwise(0).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("first", "last", "profile", F.coalesce("tx_enable", F.lit(0)).alias("mask"), n.alias("n"))))
    whole = found.groupBy("capture_id").agg(F.flatten(F.transform(ordered, lambda c: F.array_repeat(c["mask"], c["n"]))).alias("masks"))
    return whole.select("capture_id", F.posexplode("masks").alias("pos", "tx_mask")).withColumn("tx_name", tx_name(F.col("tx_mask")))


def transmit_pattern(found: DataFrame) -> DataFrame:
    """(capture_id, tx_masks, defined_unique, active_tx, positions_by_mask)."""
    pos = positions(found)
    masks = F.array_sort(F.collect_list(F.struct("pos", "tx_mask")))["tx_mask"]
    whole = pos.groupBy("capture_id").agg(masks.alias("tx_masks"), F.count(F.lit(1)).alias("defined_unique"), F.array_sort(F.collect_set(F.when(F.col("tx_mask") != 0, F.col("tx_name")))).alias("active_tx"))
    by_mask = pos.where("tx_mask != 0").groupBy("capture_id", "tx_mask").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    maps = by_mask.groupBy("capture_id").agg(F.map_from_entries(F.collect_list(F.struct("tx_mask", "p"))).alias("positions_by_mask"))
    return whole.join(maps, "capture_id", "left")


def with_dimensions(x: DataFrame) -> DataFrame:
    """num_rx, unique_chirps, chirps_per_frame, words_per_frame, mismatch, and the alternative resolutions."""
    unique = F.coalesce(F.nullif("defined_unique", F.lit(0)), "frame_unique", F.lit(1))
    x = x.withColumns({"num_rx": F.greatest(F.lit(1), F.bit_count(F.coalesce("rx_mask", F.lit(0)).bitwiseAND(F.lit(15)))), "unique_chirps": unique, "unique_mismatch": F.coalesce(F.col("frame_unique") != F.nullif("defined_unique", F.lit(0)), F.lit(False))})
    x = x.withColumns({"chirps_per_frame": F.col("unique_chirps") * F.coalesce("loops", F.lit(1)), "frames": F.coalesce(F.nullif("num_frames", F.lit(0)), F.lit(1))})
    # only formats that are complex by name have two words a sample: pseudo-real and unknown ones have one
    per_sample = F.when(F.upper(F.coalesce("adc_fmt", F.lit("Complex1X"))).contains("COMPLEX"), 2).otherwise(1)
    complex_only = F.col("adc_fmt").like("Complex%")
    n_eff = F.when(complex_only, F.col("fs_mhz") * F.col("eff_window_us"))
    pad = next_pow2(F.col("num_samples"))
    res = F.coalesce("eff_range_res_m", "range_res_m")
    return x.withColumns({
        "words_per_frame": F.col("chirps_per_frame") * F.col("num_rx") * F.col("num_samples") * per_sample,
        "n_effective": n_eff, "range_res_from_fs_m": F.when(n_eff > 0, C * F.col("fs_mhz") / (2 * F.col("slope_mhz_us") * n_eff)),
        "range_res_windowed_m": F.col("eff_range_res_m") * BROADENING["hann"], **{f"range_res_{kind}_m": F.col("eff_range_res_m") * v for kind, v in BROADENING.items()},
        "bin_m": F.when(F.col("num_samples") > 0, res), "padded_bin_m": F.when(F.col("num_samples") > 0, res * F.col("num_samples") / pad),
        "max_range_half_m": F.when((F.col("fs_mhz") > 0) & (F.col("slope_mhz_us") > 0), C * F.col("fs_mhz") * 1e6 / (4 * F.col("slope_mhz_us") * 1e12)),
        "max_range_full_m": F.when((F.col("fs_mhz") > 0) & (F.col("slope_mhz_us") > 0), C * F.col("fs_mhz") * 1e6 / (2 * F.col("slope_mhz_us") * 1e12)),
        "range_bins_256": F.when(F.upper("adc_fmt").contains("COMPLEX"), 256).otherwise(129),
        "fps": F.coalesce(F.try_divide(F.lit(1000.0), F.nullif("frame_period_ms", F.lit(0.0))), F.lit(15.0)),
        "period_ms": F.when(F.col("frame_period_ms") > 0, F.bround("frame_period_ms").cast("int")),
    })


def chirp_values(caps: DataFrame, found: DataFrame) -> DataFrame:
    """Effective slope, window, bandwidth and start of every chirp of every capture."""
    x = found.join(caps.select("capture_id", "band", "slope_const", "ramp_us", "adc_start_us", "start_freq_ghz", "sample_time_us"), "capture_id")
    by_band = lambda c, table: F.when(F.col("band") == "77", c * F.lit(table["77"])).otherwise(c * F.lit(table["60"]))
    zero = lambda c: F.coalesce(c, F.lit(0))
    slope = by_band(F.col("slope_const") + zero("slope_var"), SLOPE_LSB)
    adc = F.coalesce("adc_start_us", F.lit(0.0)) + zero("adc_start_var") / 100
    window = F.least(F.greatest(F.lit(0.0), F.col("ramp_us") - adc), F.col("sample_time_us"))
    x = x.withColumns({"eff_slope": slope, "adc_us": adc, "eff_window_us": window})
    moved = by_band(zero("start_var") / F.lit(float(1 << 26)), START_GHZ)
    return x.select("capture_id", "first", "last", "profile", "tx_enable", tx_name(F.col("tx_enable")).alias("tx_active"), "eff_slope", "eff_window_us", (F.col("eff_slope") * F.col("eff_window_us")).alias("eff_bandwidth_mhz"), (F.col("start_freq_ghz") + moved + F.col("eff_slope") * F.col("adc_us") / 1000).alias("eff_start_ghz"))


def selectable_tx(pos: DataFrame) -> DataFrame:
    """(capture_id, tx_name, first_pos, tx_positions): active transmitters in order of appearance."""
    return pos.where("tx_mask != 0").groupBy("capture_id", "tx_name").agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_list("pos")).alias("tx_positions"))


#: Titles of the groups, and the parameters in each, in the order in which they are shown.
GROUPS = {
    "General": ["profiles_found", "chip", "chip_band", "band", "start_freq_ghz", "eff_start_ghz", "stop_freq_ghz", "slope_const", "slope_mhz_us", "idle_us", "adc_start_us", "tx_start_us", "ramp_us", "num_samples", "fs_mhz"],
    "Bandwidth & Resolution": ["bandwidth_ghz", "eff_bandwidth_ghz", "range_res_m", "eff_range_res_m", "range_res_windowed_m", "sample_time_us", "ramp_window_us", "eff_window_us"],
    "Data Format": ["adc_fmt", "adc_bits", "iq_order", "rx_mask", "num_rx", "interleaved", "num_lanes", "lanes_source"],
    "RX/TX & Gains": ["rx_gain", "tx_backoff", "tx_phase"],
    "Frame (derived/log)": ["frame_period_ms", "unique_chirps", "frame_unique", "unique_mismatch"],
    "FrameConfig": ["chirp_start", "chirp_end", "frame_unique", "loops", "chirps_per_frame", "num_frames", "frame_period_ms"],
}
CHIRP = ["tx_enable", "tx_active", "start_var", "slope_var", "idle_var", "adc_start_var", "bpf"]


def grouped_view(caps: DataFrame, found: DataFrame) -> DataFrame:
    """(capture_id, param_group, ord, name, value): the parameters that a capture has, by group, as text; the transmit pattern; and a group for each of its chirps (found)."""
    item = lambda ord_, group, name, value: F.struct(ord_.cast("int").alias("ord"), group.alias("param_group"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    there = lambda group, value: F.when(F.col("FrameConfig").isNotNull(), value) if group == "FrameConfig" else value
    every = [item(F.lit(100 * i + j), F.lit(g), n, there(g, F.col(n))) for i, (g, names) in enumerate(GROUPS.items()) for j, n in enumerate(names)]
    places = F.transform(F.array_sort(F.map_entries("positions_by_mask")), lambda e: F.concat(tx_name(e["key"]), F.lit(": "), F.array_join(e["value"].cast("array<string>"), ",")))
    pattern = {"order": F.array_join(F.transform("tx_masks", tx_name), " | "), "active": F.array_join("active_tx", ", "), "pattern_len": F.when(F.col("tx_masks").isNotNull(), F.size("tx_masks")), "positions": F.array_join(places, " | ")}
    every += [item(F.lit(100 * len(GROUPS) + j), F.lit("Chirp TX Pattern"), n, c) for j, (n, c) in enumerate(pattern.items())]
    # a log defines some tens of chirps at most, so their order within a capture is a small window
    nth = F.row_number().over(Window.partitionBy("capture_id").orderBy("first", "last", "profile"))
    title = F.format_string("Chirp %d-%d (prof %d)", "first", "last", "profile")
    chirps_ = found.join(caps.select("capture_id"), "capture_id", "left_semi").withColumn("tx_active", tx_name(F.col("tx_enable"))).withColumn("nth", nth)
    parts = chirps_.select("capture_id", F.explode(F.array(*[item(100 * (len(GROUPS) + F.col("nth")) + j, title, n, F.col(n)) for j, n in enumerate(CHIRP)])).alias("p"))
    return caps.select("capture_id", F.explode(F.array(*every)).alias("p")).unionByName(parts).select("capture_id", "p.*").where("value is not null")
