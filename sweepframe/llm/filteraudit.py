"""What each filter of a corpus removes, alone and in every order, counted over a stream of files that takes back what it said too early.

All files are read as available-now micro-batches. Four filters look at a text
alone; the fifth fails a text that a smaller id has, too, so whether a document
fails it is known only when all files are. State keyed by the hash of the text
holds the smallest id so far of each text. A document that comes with a larger id
fails; one with a smaller id takes its place, and the earlier one's count goes
from the mask it had to the mask with the fifth failure: the part counters get a
row of -1 and one of +1. Batches add up their changes and write them under their
number, so one that is run again after a failure writes the same place.

A row of state holds about TEXTS texts that share hash bits, since a call of
Python for each text would cost more than all else: about 100 bytes a text, in
the state store that the session is set to (the default one keeps it in memory,
RocksDB on disk). Repeats are folded before
the shuffle: of equal texts in a batch of rows only the smallest id goes on, the
others fail for sure and go as counts.

From the 32 masks of failures that a part has, all orders and steps follow by
arithmetic; a filter's removals over all 120 orders are 120 / k for a document
that fails k filters.

Defined results: a null text counts as empty; texts are the same if their
SHA-256 is; a null id is not smaller than any and no other is smaller, so it
neither fails the fifth filter nor makes others fail; rows that repeat an id and
text don't fail for each other; null and empty sources are one part; a document
with several labels is good or toxic if one of them says so; a table without
rows gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.functions.scratch import few_rows, join_small, materialise, new_path, settings
from sweepframe.llm.words import word_lists

FILTERS = "ABCDE"
#: Texts that share a row of state, least bytes of a micro-batch, and most of them whatever the input.
TEXTS, BATCH_BYTES, MOST_BATCHES = 256, 256 << 20, 64
#: Rows of one id that meet its labels in one task, where labels are too many to be sent to all tasks; an id with more rows is copied for every so many.
REPEATS = 1 << 12
_REPEATED = 1 << FILTERS.index("E")
_CAPITALS, _INNER, _SIGNS = bytes(range(65, 91)), bytes(range(128, 192)), re.compile(rb"[#$%&*|]")
#: Settings of the stream: bytes of a batch that goes to Python.
_STREAM = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def mask_of(body: bytes) -> int:
    """The filters that a UTF-8 text fails by itself, a bit for each."""
    n, distinct = 0, set()
    for words in word_lists(body):
        n += len(words)
        distinct.update(words)
    capitals, points = len(body) - len(body.translate(None, _CAPITALS)), len(body.translate(None, _INNER))
    return (n < 50) | (100 * len(distinct) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | bool(_SIGNS.search(body)) << 3


def _batch(rows: Counter, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*((*k, n) for k, n in rows.items()))) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_FLAGS = [("good", pa.bool_()), ("toxic", pa.bool_())]
_JUDGED = pa.schema([("digest", pa.string()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
_FOLDED = pa.schema([("bucket", pa.int32()), ("digest", pa.string()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), *_FLAGS, ("n", pa.int64())])


def _judge(batch: pa.RecordBatch, more: list[str]) -> Counter:
    """(digest, doc_id, part, mask, more): rows of a batch that agree in all of it are counted."""
    others = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", *more)))
    bodies = (b.as_buffer().to_pybytes() if b.is_valid else b"" for b in batch.column("text"))
    return Counter((hashlib.sha256(b).hexdigest(), i, p, mask_of(b), *flags) for b, (i, p, *flags) in zip(bodies, others))


def _fold(rows: Counter, buckets: int) -> Counter:
    """Rows for the state: of each text of a batch those with the smallest id. The others, and those without an id, are counts: their digest is null, and their mask is final."""
    least: dict[str, int] = {}
    for digest, i, *_ in rows:
        if i is not None and i < least.get(digest, i + 1):
            least[digest] = i
    out: Counter = Counter()
    for (digest, i, part, mask, good, toxic), n in rows.items():
        first = i is not None and i == least[digest]
        key = (digest, i, part, mask) if first else (None, None, part, mask if i is None else mask | _REPEATED)
        bucket = int(digest[:8], 16) if first else int(hashlib.md5(f"{part} {mask}".encode()).hexdigest()[:8], 16)
        out[(bucket % buckets, *key, good, toxic)] += n
    return out


_FOLDED_ROWS = "bucket int, digest string, doc_id long, part string, mask int, good boolean, toxic boolean, n long"


def folded(docs: DataFrame, known: DataFrame, buckets: int, ids: DataFrame) -> DataFrame:
    """Documents (doc_id, part, text) with the flags good and toxic of their id in known, judged and folded in batches of rows. ids: the column doc_id of all documents.

    Few labels are sent to all tasks before texts are looked at, and one task does
    all. Many meet the judged rows, without texts, in a shuffle by id, over which
    rows of an id that has very many, or of none, are spread by their text. That
    join is always a sorted one: a file of labels that is small enough to be sent
    to all tasks makes a table in the driver that is many times as large.
    """
    flagged = lambda rows: rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    if few_rows(known):

        def all_in_one(batches):
            for batch in batches:
                yield _batch(_fold(_judge(batch, ["good", "toxic"]), buckets), _FOLDED)

        return flagged(docs.join(F.broadcast(known), "doc_id", "left")).mapInArrow(all_in_one, _FOLDED_ROWS)

    def judge(batches):
        for batch in batches:
            yield _batch(_judge(batch, []), _JUDGED)

    def fold(batches):
        for batch in batches:
            rows: Counter = Counter()
            for *key, n in zip(*[batch.column(c).to_pylist() for c in ("digest", "doc_id", "part", "mask", "good", "toxic", "n")]):
                rows[tuple(key)] += n
            yield _batch(_fold(rows, buckets), _FOLDED)

    rows = docs.mapInArrow(judge, "digest string, doc_id long, part string, mask int, n long")
    many = materialise(ids.where("doc_id is not null").groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / REPEATS).cast("int").alias("copies")).where("copies > 1"))
    copied = lambda rows: join_small(rows, many, "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    salt = F.pmod(F.xxhash64("digest"), F.when(F.col("doc_id").isNull(), 1 << 20).otherwise(F.col("copies"))).cast("int")
    copies = copied(known).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return flagged(copied(rows).withColumn("salt", salt).drop("copies").join(copies.hint("merge"), ["doc_id", "salt"], "left")).mapInArrow(fold, _FOLDED_ROWS)


def retracted(key: tuple, frames, state):
    """Changes of the part counters (part, mask, good, toxic, n) by the rows of one bucket; its state: {digest: [mask, smallest id, [[part, good, toxic, n] of the rows that have it]]}."""
    held = json.loads(state.get[0]) if state.exists else {}
    changes: Counter = Counter()
    touched = False
    for frame in frames:
        for digest, i, part, mask, good, toxic, n in zip(*(frame[c].tolist() for c in ("digest", "doc_id", "part", "mask", "good", "toxic", "n"))):
            if digest is None:
                changes[part, mask, good, toxic] += n
                continue
            i = int(i)
            known = held.get(digest)
            if known is not None and i > known[1]:
                changes[part, mask | _REPEATED, good, toxic] += n
                continue
            touched = True
            if known is not None and i < known[1]:
                for p, g, t, m in known[2]:
                    changes[p, mask, g, t] -= m
                    changes[p, mask | _REPEATED, g, t] += m
                known = None
            if known is None:
                held[digest] = known = [mask, i, []]
            known[2].append([part, good, toxic, n])
            changes[part, mask, good, toxic] += n
    if touched:
        state.update((json.dumps(held),))
    rows = [(*k, n) for k, n in changes.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "n"]).astype({"mask": np.int32, "n": np.int64, "good": bool, "toxic": bool})


_CHANGES = "part string, mask int, good boolean, toxic boolean, n long"


def _listed(spark: SparkSession, path: str) -> tuple[str, int]:
    """The path as a stream takes it (a pattern, if it is one file), and the bytes under it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    size = system.getContentSummary(place).getLength()
    return (path if system.getFileStatus(place).isDirectory() else f"{path[:-1]}[{path[-1]}]"), size


def counters(spark: SparkSession, path: str, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a Parquet folder by the filters that they fail, and how many of them are good and toxic.

    labels has doc_id, quality and toxic.
    """
    table = spark.read.parquet(path)
    buckets = max(1, table.count() // TEXTS)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = materialise(known.where("good or toxic"))
    pattern, size = _listed(spark, path)
    files = spark.readStream.schema(table.select(doc_id, text, part).schema).option("maxBytesPerTrigger", max(batch_bytes, size // MOST_BATCHES)).parquet(pattern)
    docs = files.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").cast("binary").alias("text"))
    changes = folded(docs, known, buckets, table.select(F.col(doc_id).cast("long").alias("doc_id"))).groupBy("bucket").applyInPandasWithState(retracted, _CHANGES, "texts string", "append", "NoTimeout")
    told = new_path(spark, "changes")

    def tell(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{told}/batch={number}")

    with settings(spark, _STREAM):
        query = changes.writeStream.foreachBatch(tell).outputMode("append").option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    empty = spark.createDataFrame([], _CHANGES)
    place = spark._jvm.org.apache.hadoop.fs.Path(told)
    all_changes = spark.read.schema(empty.schema).parquet(told) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else empty
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return all_changes.groupBy("part", "mask").agg(F.sum("n").alias("n"), when("good"), when("toxic")).where("n != 0")


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, its filter's bit, bits of the filters before it) of all orders of the filters."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [("".join(o), k + 1, bit[o[k]], sum(bit[f] for f in o[:k])) for o in itertools.permutations(FILTERS) for k in range(len(o))]


def interactions(found: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) -> a row for each part, order and step."""
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 of them
    steps = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("before")) for o, s, b, e in orders()])).alias("x")
    rows = parts.select("part", "cells", steps).select("part", "cells", "x.*")
    has = lambda m, bits: m["mask"].bitwiseAND(bits) != 0
    total = lambda test, what="n": F.aggregate("cells", F.lit(0).cast("long"), lambda s, m: s + F.when(test(m), m[what] if isinstance(what, str) else what(m)).otherwise(0).cast("long"))
    bit, before = F.col("bit"), F.col("before")
    gone = lambda m: has(m, bit) & ~has(m, before)
    all_orders = len(orders()) // len(FILTERS)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~has(m, bit.bitwiseOR(before))).alias("kept"), total(gone).alias("removed"), total(lambda m: has(m, bit) & has(m, before)).alias("redundant"), total(lambda m: m["mask"] == bit).alias("unique_fails"),
        total(gone, "good").alias("good_lost"), total(gone, "toxic").alias("toxic_lost"), total(lambda m: has(m, bit), lambda m: m["n"] * all_orders / F.bit_count(m["mask"])).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, **how) -> DataFrame:
    """interactions of the filters in each part of a Parquet folder."""
    return interactions(materialise(counters(spark, path, labels, **how)))
