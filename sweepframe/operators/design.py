"""From measurement goals to chirp parameters, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.functions.signal import C0, next_pow2

MAX_BANDWIDTH_GHZ = 4.0
MAX_RATE_MSPS = 40.0
#: name, range m, resolution cm, velocity m/s, velocity resolution m/s
PRESETS = [("long_range", 50.0, 20.0, 5.0, 0.5), ("respiration", 2.0, 1.0, 0.2, 0.02)]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "goal_id string, max_range_m double, range_res_cm double, max_vel_ms double, vel_res_ms double").withColumn("start_freq_ghz", F.lit(77.0))


def parameters(goals: DataFrame) -> DataFrame:
    """goals with the chirp that meets them, and the reason where none does (its values are null then)."""
    x = goals.withColumns({"bandwidth_mhz": C0 / (2 * F.col("range_res_cm") / 100) / 1e6, "wavelength": C0 / (F.col("start_freq_ghz") * 1e9)})
    x = x.withColumn("chirp_s", F.col("wavelength") / (4 * F.col("max_vel_ms")))
    x = x.withColumn("ramp_s", F.col("chirp_s") * 0.8)
    wide = F.col("bandwidth_mhz") / 1e3 > MAX_BANDWIDTH_GHZ
    x = x.withColumn("slope", F.col("bandwidth_mhz") * 1e6 / F.col("ramp_s"))
    x = x.withColumn("rate", F.col("slope") * 2 * F.col("max_range_m") / C0 * 1.25)
    fast = F.col("rate") / 1e6 > MAX_RATE_MSPS
    x = x.withColumn("reason", F.when(wide, F.lit("bandwidth")).when(fast, F.lit("adc_rate")))
    loops = F.greatest(F.lit(16), next_pow2(F.bround(F.col("wavelength") / (2 * F.col("vel_res_ms") * F.col("chirp_s")))))
    x = x.withColumns({"chirps": loops, "samples": next_pow2(F.floor(F.col("rate") * F.col("ramp_s")))})
    ok = lambda c: F.when(F.col("reason").isNull(), c)
    return x.select(
        *goals.columns, "reason", ok(F.col("bandwidth_mhz")).alias("bandwidth_mhz"), ok(F.col("slope") / 1e12).alias("slope_mhz_us"), ok(F.col("samples")).alias("adc_samples"), ok(F.col("samples") / F.col("ramp_s") / 1e6).alias("adc_rate_msps"),
        ok(F.col("ramp_s") * 1e6).alias("ramp_us"), ok(F.col("chirp_s") * 0.2 * 1e6).alias("idle_us"), ok(F.col("chirp_s") * 1e6).alias("chirp_us"), ok(F.col("chirps")).alias("chirps"), ok(F.col("chirps") * F.col("chirp_s") * 1e3).alias("frame_period_ms"),
        ok(F.lit(100.0)).alias("frame_duty_pct"), ok(100 * F.col("ramp_s") / F.col("chirp_s")).alias("ramp_duty_pct"),
    )
