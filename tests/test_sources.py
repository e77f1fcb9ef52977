"""Files: raw captures by frame-aligned splits, logs, matrix files."""

import numpy as np
from pyspark.sql import functions as F

from sweepframe.sources import captures


def test_captures_are_split_on_frames(spark, tmp_path):
    words = np.arange(10 * 6 + 3, dtype="<i2")
    (tmp_path / "a_Raw_0.bin").write_bytes(words.tobytes())
    (tmp_path / "b.bin").write_bytes(words[:12].tobytes())
    df = captures.read_captures(spark, [f"file://{tmp_path}/a_Raw_0.bin", f"file://{tmp_path}/b.bin"], 6, frames_per_split=4)
    rows = sorted(df.collect())
    assert df.rdd.getNumPartitions() == 4
    assert [(r.path[-5:], r.frame) for r in rows] == [("0.bin", f) for f in range(10)] + [("b.bin", f) for f in range(2)]
    assert all(r.words == list(range(6 * r.frame, 6 * r.frame + 6)) for r in rows)


def test_logs_keep_their_order(spark, tmp_path):
    (tmp_path / "x_LogFile.txt").write_text("one\r\ntwo\n\nthree\n")
    rows = captures.read_logs(spark, f"file://{tmp_path}").orderBy("line_no").collect()
    assert [r.line for r in rows] == ["one", "two", "three"] and [r.line_no for r in rows] == [0, 1, 3]


def test_log_names(spark):
    df = spark.createDataFrame([("X_Raw_0.bin",), ("Y.bin",), ("Z_Raw_12.bin",)], "f string").select(captures.log_name(F.col("f")))
    assert [r[0] for r in df.collect()] == ["X_LogFile.txt", "Y_LogFile.txt", "Z_LogFile.txt"]


def test_matrix_files(spark, tmp_path):
    cells = spark.createDataFrame([(f, d, r, float(100 * f + 10 * d + r)) for f in range(3) for d in range(2) for r in range(2)], "frame int, d int, r int, mag double")
    captures.write_matrix_csv(captures.matrix_rows(cells, ["frame"], ["d", "r"], "mag"), f"{tmp_path}/m", 4)
    got = spark.read.csv(f"{tmp_path}/m", inferSchema=True)
    assert sorted(map(tuple, got.collect())) == [(0.0, 1.0, 10.0, 11.0), (100.0, 101.0, 110.0, 111.0), (200.0, 201.0, 210.0, 211.0)]
    captures.write_tables(cells.withColumn("capture_id", F.lit("c")), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").where("capture_id = 'c'").count() == 12


def test_recordings_in_several_files(spark, tmp_path):
    words = np.arange(100, dtype="<i2")
    for k, (a, b) in enumerate(((0, 13), (13, 15), (15, 100))):
        (tmp_path / f"a_Raw_{k}.bin").write_bytes(words[a:b].tobytes())
    paths = [f"file://{tmp_path}/a_Raw_{k}.bin" for k in (2, 0, 1)]
    rows = sorted(captures.read_captures(spark, paths, 6, frames_per_split=2).collect())
    assert {r.path[-11:] for r in rows} == {"a_Raw_0.bin"[-11:]} and [r.frame for r in rows] == list(range(16))
    assert all(r.words == list(range(6 * r.frame, 6 * r.frame + 6)) for r in rows)


def test_pieces_are_where_the_bytes_are():
    rng = np.random.default_rng(1)
    for _ in range(50):
        parts = [(str(k), int(n)) for k, n in enumerate(rng.integers(0, 9, 6))]
        body = [(p, i) for p, n in parts for i in range(n)]
        a, b = sorted(rng.integers(0, len(body) + 1, 2))
        assert [(p, i) for p, at, n in captures.pieces_of(parts, a, b) for i in range(at, at + n)] == body[a:b]


def test_numbered_files_are_one_recording():
    assert captures.grouped(["d/x_Raw_10.bin", "d/x_Raw_2.bin", "d/y.bin", "e/x_Raw_0.bin", "d/y.bin"]) == {"d/x_Raw_2.bin": ["d/x_Raw_2.bin", "d/x_Raw_10.bin"], "d/y.bin": ["d/y.bin"], "e/x_Raw_0.bin": ["e/x_Raw_0.bin"]}


def test_growing_captures_as_a_stream(spark, tmp_path):
    """Files grow within a frame, a second part and a second recording come, and the query is started anew each time."""
    folder, size = tmp_path / "in", 6
    folder.mkdir()
    steps = [[("a_Raw_0.bin", 0, 15)], [("a_Raw_0.bin", 15, 20), ("b.bin", 0, 12)], [], [("a_Raw_1.bin", 20, 43), ("b.bin", 12, 13)]]
    for step in steps:
        for name, a, b in step:
            with open(folder / name, "ab") as file:
                file.write(np.arange(a, b, dtype="<i2").tobytes())
        stream = captures.stream_captures(spark, [f"file://{folder}"], size, frames_per_split=2)
        query = stream.writeStream.foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = sorted((r.path.rsplit("/", 1)[1], r.frame, *r.words) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [(name, f, *range(6 * f, 6 * f + 6)) for name, n in (("a_Raw_0.bin", 7), ("b.bin", 2)) for f in range(n)]
    batch = captures.read_captures(spark, [f"file://{folder}/{n}" for n in ("a_Raw_0.bin", "a_Raw_1.bin", "b.bin")], size)
    assert sorted((r.path.rsplit("/", 1)[1], r.frame, *r.words) for r in batch.collect()) == rows
