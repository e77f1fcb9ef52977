"""Reading raw captures and their logs, and writing results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


#: Bytes of one range of a capture.
SPLIT = 16 << 20


def read_frames(pieces: list[tuple[str, int, int]], first: int, count: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(frame, words) of frames first, first + 1, ...: pieces are (path, offset, bytes) in order, and a frame may begin in one file and end in the next. Any file system that pyarrow opens."""
    from pyarrow import fs

    held, frame = b"", first
    for path, at, length in pieces:
        system, inside = fs.FileSystem.from_uri(path)
        with system.open_input_file(inside) as file:
            end = at + length
            while at < end and frame < first + count:
                body = file.read_at(min(size - len(held), end - at), at)
                if not body:
                    raise ValueError(f"the file became shorter: {path}")
                held, at = held + body, at + len(body)
                if len(held) == size:
                    yield frame, np.frombuffer(held, "<i2")
                    held, frame = b"", frame + 1


def pieces_of(parts: list[tuple[str, int]], begin: int, end: int) -> list[tuple[str, int, int]]:
    """The pieces that hold the bytes from begin to end of files put together in order; parts: (path, length)."""
    found, start = [], 0
    for path, length in parts:
        low, high = max(begin, start), min(end, start + length)
        if low < high:
            found.append((path, low - start, high - low))
        start += length
    return found


def grouped(paths: list[str]) -> dict[str, list[str]]:
    """The files of each recording in order, by the first of them: X_Raw_0.bin, X_Raw_1.bin, ... are one recording, another file is one by itself."""
    found: dict = {}
    for path in dict.fromkeys(paths):
        cut = re.fullmatch(r"(.*)_Raw_(\d+)\.bin", path)
        found.setdefault(cut[1] if cut else path, []).append((int(cut[2]) if cut else 0, path))
    return {(own := [p for _, p in sorted(parts)])[0]: own for parts in found.values()}


class _Slice(InputPartition):
    def __init__(self, uri: str, pieces: list[tuple[str, int, int]], first: int, frames: int):
        self.uri, self.pieces, self.first, self.frames = uri, pieces, first, frames


class CaptureSource(DataSource):
    """Format `radar_capture`: files of little-endian 16-bit words as rows (path, frame, words), of a batch or a stream.

    Options: paths (separated by commas), words_per_frame, frames_per_split. The
    numbered files of a recording count as one under the path of the first; a
    frame cut short at the end is dropped, or in a stream waited for. Each split
    is a range of frames, so a long capture is read by many tasks and none holds
    a file. In a stream the files may grow and get successors; the offset of a
    stream is the number of frames of every recording so far.
    """

    @classmethod
    def name(cls):
        return "radar_capture"

    def schema(self):
        return "path string, frame long, words array<smallint>"

    def reader(self, schema):
        return CaptureReader(self.options)

    def streamReader(self, schema):
        return CaptureStreamReader(self.options)


class _Frames:
    """What readers of batches and streams share."""

    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.words = int(options["words_per_frame"])
        self.step = int(options.get("frames_per_split", max(1, SPLIT // (2 * self.words))))

    def slices(self, uri: str, parts: list[tuple[str, int]], first: int, last: int) -> list[_Slice]:
        size, cuts = 2 * self.words, range(first, last, self.step)
        return [_Slice(uri, pieces_of(parts, f * size, min(f + self.step, last) * size), f, min(self.step, last - f)) for f in cuts]

    def read(self, part):
        for frame, words in read_frames(part.pieces, part.first, part.frames, 2 * self.words):
            yield pa.RecordBatch.from_pydict({"path": [part.uri], "frame": pa.array([frame], pa.int64()), "words": pa.array([words], pa.list_(pa.int16()))})


class CaptureReader(_Frames, DataSourceReader):
    def partitions(self):
        from pyarrow import fs

        out = []
        for uri, paths in grouped(self.paths).items():
            parts = [(p, system.get_file_info(inside).size or 0) for p in paths for system, inside in [fs.FileSystem.from_uri(p)]]
            if not sum(n for _, n in parts):
                raise ValueError(f"no capture, or an empty one: {uri}")
            out += self.slices(uri, parts, 0, sum(n for _, n in parts) // (2 * self.words))
        return out


class CaptureStreamReader(_Frames, DataSourceStreamReader):
    """paths are files, or folders of which all .bin files are read, those that come later too."""

    def _recordings(self) -> dict[str, list[tuple[str, int]]]:
        from pyarrow import fs

        sizes = {}
        for uri in self.paths:
            system, inside = fs.FileSystem.from_uri(uri)
            info = system.get_file_info(inside)
            if info.type == fs.FileType.Directory:
                sizes |= {f"{uri.rstrip('/')}/{f.base_name}": f.size for f in system.get_file_info(fs.FileSelector(inside)) if f.base_name.endswith(".bin")}
            elif info.type == fs.FileType.File:
                sizes[uri] = info.size
        return {uri: [(p, sizes[p]) for p in paths] for uri, paths in grouped(sorted(sizes)).items()}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {uri: sum(n for _, n in parts) // (2 * self.words) for uri, parts in self._recordings().items()}

    def partitions(self, start, end):
        known = self._recordings()
        return [x for uri, last in sorted(end.items()) if last > start.get(uri, 0) for x in self.slices(uri, known[uri], start.get(uri, 0), last)]


def read_captures(spark: SparkSession, paths: list[str], words_per_frame: int, **options) -> DataFrame:
    """(path, frame, words) of raw captures."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("radar_capture").option("paths", ",".join(paths)).option("words_per_frame", words_per_frame).options(**options).load()


def stream_captures(spark: SparkSession, paths: list[str], words_per_frame: int, **options) -> DataFrame:
    """(path, frame, words) of raw captures as they grow; each frame comes once, also after a restart from a checkpoint."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("radar_capture").option("paths", ",".join(paths)).option("words_per_frame", words_per_frame).options(**options).load()


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text logs: lines in order, later ones override."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("path", F.posexplode("lines").alias("line_no", "line")).where("line != ''")


def log_name(file_name):
    """The log of X_Raw_<n>.bin is X_LogFile.txt; that of another name is its stem with _LogFile.txt."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.concat(F.regexp_replace(stem, r"_Raw_\d+$", ""), F.lit("_LogFile.txt"))


def pair_logs(captures: DataFrame, logs: DataFrame) -> DataFrame:
    """Captures (dir, file_name) with log_name, null where logs (dir, log_name) have none."""
    wanted = captures.withColumn("__wanted", log_name(F.col("file_name")))
    there = logs.select(F.col("dir").alias("__dir"), F.col("log_name").alias("log_name"))
    return wanted.join(there, (F.col("dir") == F.col("__dir")) & (F.col("__wanted") == F.col("log_name")), "left").select("dir", "file_name", "log_name")


def without_log(captures: DataFrame, logs: DataFrame) -> DataFrame:
    wanted = captures.withColumn("log_name", log_name(F.col("file_name")))
    return wanted.join(logs.select("dir", "log_name"), ["dir", "log_name"], "left_anti").select("dir", "file_name")


def matrix_rows(cells: DataFrame, row_keys: list[str], order: list[str], value: str) -> DataFrame:
    """One row for each first axis, all others flattened in order into one array: the shape of a matrix file."""
    flat = F.array_sort(F.collect_list(F.struct(*order, value)))
    return cells.groupBy(*row_keys).agg(F.transform(flat, lambda x: x[value]).alias("flat"))


def write_matrix_csv(rows: DataFrame, path: str, width: int) -> None:
    """matrix_rows as CSV, one column for each element, in the order of the keys."""
    keys = [c for c in rows.columns if c != "flat"]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*[F.get("flat", F.lit(i)).alias(f"c{i}") for i in range(width)]).write.mode("errorifexists").csv(path)


def write_tables(rows: DataFrame, path: str) -> None:
    """The default sink: Parquet by capture, sorted by frame within each."""
    rows.repartitionByRange("capture_id", "frame").sortWithinPartitions("capture_id", "frame").write.mode("errorifexists").partitionBy("capture_id").parquet(path)
