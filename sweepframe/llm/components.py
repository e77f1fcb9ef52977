"""Connected components of a graph given as edges, by contraction.

Every round ties each node to its smallest neighbour, if that is smaller, follows
these ties to their ends, and goes on with the graph of the ends. Rounds are
joins and aggregates over tables written to the shared folder; neither edges nor
labels come to the driver as rows of Python. A round shuffles the edges twice,
each time aggregated before the shuffle, so that hot nodes don't land in one
task; the ties are sent to all tasks while their counted rows are few, else the
joins are plain shuffled joins that adaptive execution may split.

Defined results: null ends and loops are ignored, repeated edges count once;
nodes without an edge are absent; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scratch import BROADCAST_ROWS, few_rows, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of the component of every node that has an edge."""
    found = tied(edges, a, b)
    return found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())


def tied(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that isn't the smallest of its component, as a written table.

    A node that stays in two rounds has been the smallest neighbour of one that
    went in the first, so two rounds leave half of the nodes at most.
    """
    now, found = materialise(_edges(edges, a, b)), None
    while True:
        n = now.count()
        if not n:
            return now.toDF("node", "root") if found is None else found
        ties = materialise(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
        few = n <= BROADCAST_ROWS or few_rows(ties)
        ties = _followed(ties, few)
        found = ties if found is None else materialise(_through(found, "root", ties, few).unionAll(ties))
        now = materialise(_edges(_through(_through(now, "u", ties, few), "v", ties, few), "u", "v"))


def _edges(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v): the distinct edges between different nodes, the larger one first."""
    x, y = F.col(a), F.col(b)
    return rows.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()


def _through(rows: DataFrame, column: str, ties: DataFrame, few: bool) -> DataFrame:
    """rows whose column holds what its value is tied to, if it is tied."""
    held = ties.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    found = rows.join(F.broadcast(held) if few else held, F.col(column) == F.col("__node"), "left")
    return found.select(*[F.coalesce("__root", c).alias(c) if c == column else c for c in rows.columns])


def _followed(ties: DataFrame, few: bool) -> DataFrame:
    """The ties to the ends of their chains: each pass makes what is left of a chain a third as long at least."""
    while True:
        once = _through(ties, "root", ties, few).withColumn("one", F.col("root"))
        ties = materialise(_through(once, "root", ties, few))
        if ties.where("root != one").isEmpty():
            return ties.drop("one")
        ties = ties.drop("one")
