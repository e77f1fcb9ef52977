"""Tables cut from their lineage in a folder that all executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is sent to every executor.
BROADCAST_ROWS = 200_000
#: Setting under which a query's shuffle files go when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Setting of the most bytes in a batch that goes to a Python worker, and its value while a table is written: worker and executor hold such batches outside the heap.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_own: list[str] = []
_folders: set[str] = set()
#: Open scopes of this thread; what another thread writes is not theirs.
_open: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())
#: Settings that blocks hold now: how many hold them, and the value from before the first.
_held: dict[tuple, list] = {}
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a new folder under /tmp if driver and executors are one process (local mode), else an error: on a cluster each machine would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own[0]


def _application_dir(spark: SparkSession) -> str:
    """A folder for this application's tables within the shared one; the file system removes it when the application ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(place)
        system.deleteOnExit(place)
        _folders.add(folder)
    return folder


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the innermost open scope of this thread, or in the application's folder."""
    scopes = _open.get()
    return f"{scopes[-1] if scopes else _application_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a written Parquet table, read again: later jobs neither recompute it nor depend on an executor, so the shuffles that made it are removed."""
    spark = df.sparkSession
    path = path or new_path(spark)
    with settings(spark, {_CLEAN: "true", _BATCH: str(BATCH_BYTES)}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for as long as the block lasts. Blocks of several threads may hold one setting; the last that ends puts back what was there before the first."""
    keys = [(id(spark), k) for k in values]
    with _lock:
        for key, value in zip(keys, values.values()):
            _held.setdefault(key, [0, spark.conf.get(key[1], None)])[0] += 1
            spark.conf.set(key[1], value)
    try:
        yield
    finally:
        with _lock:
            for key in keys:
                _held[key][0] -= 1
                if not _held[key][0]:
                    before = _held.pop(key)[1]
                    spark.conf.unset(key[1]) if before is None else spark.conf.set(key[1], before)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession):
    """Tables that this thread writes inside go when the block ends; what must outlive it is written by the caller to a path from outside."""
    folder = new_path(spark, "scope")
    token = _open.set((*_open.get(), folder))
    try:
        yield folder
    finally:
        _open.reset(token)
        delete(spark, folder)


def few_rows(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows."""
    return df.count() <= most


def join_small(left: DataFrame, small: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """left joined with a written table: broadcast when its counted rows are few, else a shuffled join that adaptive execution may split."""
    return left.join(F.broadcast(small) if few_rows(small, most) else small, on, how)
