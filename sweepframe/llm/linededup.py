"""Line dedup by overlapping windows of three lines.

A text is cut at line feeds. Every run of three lines is hashed to 128 bits;
windows that occur more than once in the corpus are found by an aggregate, and
of each the first occurrence (least doc_id, then least place) stays. The lines
that later occurrences cover are merged and removed, but for those that a first
occurrence of a repeated window covers, too (windows may overlap), so every
repeated window still stands in the result.

Defined results: a text of fewer than three lines has no window and stays as it
is, as do null and empty texts; windows of blank lines alone don't count; a
text all of whose lines go becomes empty. Rows that repeat both id and text
are one document and keep the same lines; a null id comes before all others. An
empty table gives an empty result. Extra columns pass through; a column of the
name of the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scratch import materialise, new_path, scope
from sweepframe.llm.words import free_names

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, of, place, h1, h2): the windows of every text. `of` tells texts with the same id apart."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("of"), _lines(F.col(text)).alias("lines")).where(F.size("lines") >= window)
    line = lambda i, k: F.get("lines", i + k)
    spans = F.transform(F.sequence(F.lit(0), F.size("lines") - window), lambda i: F.struct(i.alias("place"), F.xxhash64(*[line(i, k) for k in range(window)]).alias("h1"), F.xxhash64(F.lit("again"), *[line(i, k) for k in reversed(range(window))]).alias("h2"), (F.trim(F.concat(*[line(i, k) for k in range(window)])) == "").alias("blank")))
    return rows.select("id", "of", F.explode(spans).alias("w")).where("not w.blank").select("id", "of", "w.place", "w.h1", "w.h2")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, of, gone): the line numbers to remove, for texts that have any."""
    found = materialise(windows(docs, doc_id, text, window))
    firsts = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "of", "place")).alias("first")).where("n > 1")
    firsts = materialise(firsts.select("h1", "h2", "first"))
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("of") == F.col("first.of")) & (F.col("place") == F.col("first.place"))
    places = found.join(firsts, ["h1", "h2"]).groupBy("id", "of").agg(F.collect_set(F.when(~first, F.col("place"))).alias("later"), F.collect_set(F.when(first, F.col("place"))).alias("firsts"))
    covered = lambda at: F.flatten(F.transform(at, lambda p: F.sequence(p, p + (window - 1))))
    return places.select("id", "of", F.array_except(covered("later"), covered("firsts")).alias("gone")).where(F.size("gone") > 0)


def dedup_lines(docs: DataFrame, into: str = "line_dedup", doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the text as it stays and a struct `into`: n_lines and n_removed."""
    path, own = new_path(docs.sparkSession), free_names(docs, "id", "of", "gone", "x", "lines", but=into)
    id_, of, gone_, x, lines = own
    with scope(docs.sparkSession):
        gone = materialise(repeated_lines(docs, doc_id, text, window).select(F.col("id").alias(id_), F.col("of").alias(of), F.col("gone").alias(gone_)), path)
    rows = docs.withColumn(x, F.xxhash64(text))
    # the list of removals grows with the corpus, so it is never broadcast: the plan is the same at every size
    rows = rows.join(gone.hint("merge"), F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(x) == F.col(of)), "left")
    rows = rows.withColumn(lines, _lines(F.col(text)))
    # array_except hashes, so long texts cost no more by line than short ones
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_))
    stays = F.transform(kept, lambda i: F.get(lines, i))
    rows = rows.withColumn(into, F.struct(F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size(gone_), F.lit(0)).alias("n_removed")))
    return rows.withColumn(text, F.when(F.col(gone_).isNull(), F.col(text)).otherwise(F.array_join(stays, "\n"))).select(*[c for c in docs.columns if c != into], into)
