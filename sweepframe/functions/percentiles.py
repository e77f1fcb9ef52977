"""Exact percentiles of each capture, without one task that holds or orders all its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The first pass knows ranks to one part in so many of the capture; the second orders eight such parts for each rank.
ACCURACY = 10_000


def percentiles(rows: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """(capture_id, p array): the interpolated percentiles of the values of each capture; null values are skipped.

    A first pass brackets each rank by approximate percentiles, whose error in
    rank is bounded; a second counts the values below the bracket and orders
    those inside, each different value once. Only their share of the capture
    meets in one task, in a running sum that spills. Captures of fewer values
    than the accuracy are ordered whole.
    """
    v = rows.select("capture_id", value.cast("double").alias("v")).where("v is not null")
    margin = 4.0 / ACCURACY
    low, high = [max(0.0, s - margin) for s in shares], [min(1.0, s + margin) for s in shares]
    near = v.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [*low, *high], ACCURACY).alias("near"), F.min("v").alias("least"), F.max("v").alias("most"))
    from_ = lambda i: F.when((F.col("n") < ACCURACY) | F.lit(low[i] == 0.0), F.col("least")).otherwise(F.col("near")[i])
    to = lambda i: F.when((F.col("n") < ACCURACY) | F.lit(high[i] == 1.0), F.col("most")).otherwise(F.col("near")[len(shares) + i])
    # a value below the bracket is counted under null, one above it isn't needed
    place = [F.struct(F.lit(i).alias("i"), (F.col("v") < from_(i)).alias("below"), F.when(F.col("v").between(from_(i), to(i)), F.col("v")).alias("at")) for i in range(len(shares))]
    seen = v.join(near, "capture_id").select("capture_id", "n", F.explode(F.filter(F.array(*place), lambda x: x["below"] | x["at"].isNotNull())).alias("x"))
    counts = seen.groupBy("capture_id", "n", "x.i", "x.at").agg(F.count(F.lit(1)).alias("c"))
    line = Window.partitionBy("capture_id", "i").orderBy(F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("i") + 1)
    ranked = counts.withColumns({"upto": F.sum("c").over(line), "rank": share * (F.col("n") - 1)})
    found = ranked.groupBy("capture_id", "i", "rank").agg(F.min(F.when(F.col("upto") > F.floor("rank"), F.col("at"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("at"))).alias("b"))
    part = F.col("rank") - F.floor("rank")
    found = found.select("capture_id", F.struct("i", F.when(part == 0, F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part).alias("p")).alias("x"))
    return found.groupBy("capture_id").agg(F.array_sort(F.collect_list("x"))["p"].alias("p"))
