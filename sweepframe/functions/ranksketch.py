"""Ranks of values kept up to date: counts by narrow cells, which add up over files, days and captures.

A sketch has, for each capture, how many values lie in each cell of `step`. New
frames are counted by themselves and their sketch is added to the stored one, so
limits move without a look at old values: a percentile is known to within a
cell. One pass over the values of its cells alone makes it exact.

Defined results: null and NaN values are skipped, a capture of which nothing is
left has no row; equal values count each; percentiles are interpolated as numpy's
are; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.functions.scratch import join_small, materialise


def _values(rows: DataFrame, value: Column, step: float) -> DataFrame:
    v = rows.select("capture_id", value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    return v.withColumn("cell", F.floor(F.col("v") / step).cast("long"))


def sketch(rows: DataFrame, value: Column, step: float) -> DataFrame:
    """(capture_id, cell, n): counted where the rows are, then added up; as many rows as a capture's values span cells."""
    return _values(rows, value, step).groupBy("capture_id", "cell").agg(F.count(F.lit(1)).alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketch of all the values that the sketches are of."""
    return reduce(DataFrame.unionByName, sketches).groupBy("capture_id", "cell").agg(F.sum("n").alias("n"))


def brackets(found: DataFrame, shares: list[float]) -> DataFrame:
    """(capture_id, i, rank, first, last, below): the cells that hold the two values next to the rank of each share, and how many values lie below the first."""
    whole = Window.partitionBy("capture_id")
    line = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = found.withColumns({"upto": F.sum("n").over(line), "all": F.sum("n").over(whole)})
    each = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("all") - 1)).alias("rank")) for i, s in enumerate(shares)])
    cells = cells.withColumn("x", F.explode(each)).select("capture_id", "cell", "n", "upto", "x.*")
    holds = lambda r: F.min(F.when(F.col("upto") > r(F.col("rank")), F.struct("cell", (F.col("upto") - F.col("n")).alias("below"))))
    ends = cells.groupBy("capture_id", "i", "rank").agg(holds(F.floor).alias("a"), holds(F.ceil).alias("b"))
    return ends.select("capture_id", "i", "rank", F.col("a.cell").alias("first"), F.col("b.cell").alias("last"), "a.below")


def bounds(found: DataFrame, shares: list[float], step: float) -> DataFrame:
    """(capture_id, p array of (low, high)): between which the percentiles are, from the sketch alone."""
    each = F.struct("i", (F.col("first") * step).alias("low"), ((F.col("last") + 1) * step).alias("high"))
    ordered = F.array_sort(F.collect_list(each))
    return brackets(found, shares).groupBy("capture_id").agg(F.transform(ordered, lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("p"))


def exact(rows: DataFrame, value: Column, found: DataFrame, shares: list[float], step: float) -> DataFrame:
    """(capture_id, p array): the percentiles of the rows, of which found is the sketch. Values outside the cells that matter go no further than the scan."""
    ends = materialise(brackets(found, shares))  # a row for each capture and share
    inside = join_small(_values(rows, value, step), ends, "capture_id").where(F.col("cell").between(F.col("first"), F.col("last")))
    counts = inside.groupBy("capture_id", "i", "rank", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    line = Window.partitionBy("capture_id", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.col("below") + F.sum("c").over(line))
    at = lambda r: F.min(F.when(F.col("upto") > r(F.col("rank")), F.col("v")))
    two = ranked.groupBy("capture_id", "i", "rank").agg(at(F.floor).alias("a"), at(F.ceil).alias("b"))
    part = F.col("rank") - F.floor("rank")
    one = F.when(part == 0, F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    return two.select("capture_id", F.struct("i", one.alias("p")).alias("x")).groupBy("capture_id").agg(F.array_sort(F.collect_list("x"))["p"].alias("p"))
