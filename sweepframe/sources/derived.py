"""Radar tables derived from the given tables, so that any engine can build the same rows.

A capture is a set of rows keyed by capture_id; complex samples are two arrays,
re and im, over the fast-time axis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Radar parameters of the derived cubes: Hz, Hz/s, s.
RADAR = {"start_hz": 77e9, "slope": 60e12, "rate": 5e6, "idle_s": 10e-6, "ramp_s": 40e-6, "tx_masks": [1, 2], "frame_ms": 66.667, "bits": 16}
LOG_TIME = "01-Jan-2024 10:00:00: "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of embeddings that fill whole frames: 16 chirps of 2 receivers."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    whole = e.agg(F.floor(F.count(F.lit(1)) / 32).alias("frames")).scalar()
    keys = [F.lit("E").alias("capture_id"), F.expr("cast(vec_id div 32 as int)").alias("frame"), F.expr("cast((vec_id div 2) % 16 as int)").alias("chirp"), F.expr("cast(vec_id % 2 as int)").alias("rx")]
    return e.select(*keys, F.transform("embedding", lambda x: x.cast("double")).alias("x")).where(F.col("frame") < whole)


def complex_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube E: (capture_id, frame, chirp, rx, re, im) with 32 complex samples; chirp % 2 is the place in the transmit pattern."""
    take = lambda first: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda n: F.get("x", 2 * n + first))
    return _frames(spark, sf_dir).select("capture_id", "frame", "chirp", "rx", take(0).alias("re"), take(1).alias("im"))


def real_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube ER: the same keys with 64 real samples; im is null."""
    return _frames(spark, sf_dir).select("capture_id", "frame", "chirp", "rx", F.col("x").alias("re"), F.lit(None).cast("array<double>").alias("im"))


def raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words W: (capture_id, word_idx, v) as a recorder writes them."""
    value = F.expr("cast(cast(floor(value * 100) as bigint) % 4096 - 2048 as smallint)")
    return table(spark, sf_dir, "events").select(F.lit("W").alias("capture_id"), F.col("event_id").alias("word_idx"), value.alias("v"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid G: (capture_id, frame, doppler_idx, range_idx, mag), 16 x 32 cells in each whole frame."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    whole = e.agg(F.floor(F.count(F.lit(1)) / 512).alias("frames")).scalar()
    keys = [F.lit("G").alias("capture_id"), F.expr("cast(event_id div 512 as int)").alias("frame"), F.expr("cast((event_id div 32) % 16 as int)").alias("doppler_idx"), F.expr("cast(event_id % 32 as int)").alias("range_idx")]
    return e.select(*keys, F.col("value").cast("double").alias("mag")).where(F.col("frame") < whole)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series V: (capture_id, frame, signal), one capture for each user."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("capture_id"), (F.row_number().over(order) - 1).cast("int").alias("frame"), F.col("value").cast("double").alias("signal"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs P: (capture_id, line_no, line), one log for each supplier."""
    k = F.col("s_suppkey")
    choose = lambda *pairs: F.coalesce(*[F.when(c, F.lit(v)) for c, v in pairs])
    sure = F.lit(True)
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    lines = [
        (sure, text("API:select_chip_version,", choose((k % 3 == 0, "IWR6843"), (k % 3 == 1, "AWR1843"), (sure, "XX9999")))),
        (sure, text("API:antPhaseRot,0.1,0.2,0.3,0.4")),
        (sure, text("API:ProfileConfig,0,", choose((k % 3 == 0, "1491308088"), (k % 3 == 1, "1435388860"), (sure, "1541018358")), ",1000,600,4000,0,0,1657,0,256,5000,0,0,30,0,")),
        (sure, text("API:ChirpConfig,0,0,0,0,0,0,0,1,0,")),
        (sure, text("API:ChirpConfig,1,1,0,0,0,0,0,", choose((k % 2 == 0, "4"), (sure, "2")), ",0,")),
        (sure, text("API:ChirpConfig,0,0,0,0,5,0,0,1,0,")),
        (sure, text("API:FrameConfig,0,0,", choose((k % 4 < 3, "1"), (sure, "7")), ",16,", 8000000 + 100 * k, ",0,", k % 50, ",0,")),
        (sure, text("API:DataFmtConfig,15,2,1,", k % 2, ",0,1,")),
        (k % 5 < 3, text("API:AdcOutConfig,2,", k % 4, ",1,")),
        (k % 7 > 0, text("API:LaneConfig,", k % 16, ",")),
        (sure, text("API:LvdsLaneConfig,0,", 1 + k % 4, ",")),
        (k % 2 == 0, text("API:ProfileConfig,0,1435388860,1200,600,5000,0,0,1657,0,128,6000,0,0,30,0,")),
        (sure, text("API:ProfileConfig,0,1,2")),
        (sure, text("API:antPhaseRot,9,9,9,9")),
        (sure, text("API:FrameConfig,0,0")),
    ]
    all_lines = F.array(*[F.when(there, F.struct(F.lit(n).alias("line_no"), F.concat(F.lit(LOG_TIME), line).alias("line"))) for n, (there, line) in enumerate(lines)])
    s = table(spark, sf_dir, "supplier").select(k.cast("string").alias("capture_id"), F.explode(F.array_compact(all_lines)).alias("l"))
    return s.select("capture_id", "l.line_no", "l.line")


def recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recordings R, one for each region: words (capture_id, word_idx, v) of the vectors, dealt in turn, and logs (capture_id, line_no, line) whose settings differ by region."""
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    n = regions.count()
    dealt = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % n).cast("string").alias("capture_id"), F.expr(f"vec_id div {n}").alias("nth"), F.posexplode("embedding").alias("i", "x"))
    words = dealt.select("capture_id", (F.col("nth") * 64 + F.col("i")).alias("word_idx"), F.expr("cast(cast(floor(cast(x as double) * 1000) as bigint) % 4096 as smallint)").alias("v"))
    k = F.col("k")
    text = lambda *parts: F.concat(*[F.lit(LOG_TIME), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]])
    either = lambda there, yes, no: F.when(there, F.lit(yes)).otherwise(F.lit(no))
    lines = [
        text("API:select_chip_version,", either(k % 2 == 0, "AWR1642", "IWR6843")),
        text("API:ProfileConfig,0,", either(k % 2 == 0, 1435388860, 1491308088), ",1000,600,4000,0,0,1657,0,", either(k < 3, 16, 8), ",5000,0,0,30,0,"),
        text("API:ChirpConfig,0,0,0,0,0,0,0,1,0,"),
        F.when(k < 4, text("API:ChirpConfig,1,1,0,0,0,0,0,2,0,")),
        text("API:FrameConfig,0,0,", either(k < 4, 1, 0), ",8,", 8000000 + 1000000 * k, ",0,", F.when(k == 4, 5).otherwise(100000000), ",0,"),
        text("API:DataFmtConfig,", either(k % 2 == 0, 3, 1), ",2,1,", either(k == 3, 1, 0), ",0,1,"),
        text("API:AdcOutConfig,2,", either(k == 2, 0, 1), ",", either(k % 2 == 0, 1, 0), ","),
        text("API:LaneConfig,", either(k % 2 == 0, 3, 15), ","),
        F.when(k == 0, text("API:antGeometry0,0,0.4,1.1,1.5,")),
    ]
    every = F.array(*[F.when(line.isNotNull(), F.struct(F.lit(i).alias("line_no"), line.alias("line"))) for i, line in enumerate(lines)])
    logs = regions.select(k.cast("string").alias("capture_id"), F.explode(F.array_compact(every)).alias("l")).select("capture_id", "l.line_no", "l.line")
    return words, logs


def design_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals D: what a measurement should resolve, one row for each part."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("goal_id"), F.col("p_size").cast("double").alias("max_range_m"), (3 + p % 17).cast("double").alias("range_res_cm"),
        (1 + (p % 5) * 0.5).cast("double").alias("max_vel_ms"), (0.05 * (1 + p % 4)).cast("double").alias("vel_res_ms"), F.when(p % 2 == 0, 60.0).otherwise(77.0).alias("start_freq_ghz"),
    )
