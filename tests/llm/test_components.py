"""What components cost, and graphs whose ties are too many to be sent."""

import random

import pytest
from pyspark import TaskContext

from sweepframe.functions.scratch import settings
from sweepframe.llm import components as graphs


def brute_force(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in up)


def found(spark, edges):
    return sorted(tuple(r) for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect())


def tasks_of(spark, run):
    """What run gives, and the number of tasks that began for it: Spark numbers them one by one."""
    number = lambda: spark.sparkContext.parallelize([0], 1).map(lambda _: TaskContext.get().taskAttemptId()).first()
    before = number()
    out = run()
    return out, number() - before - 1


def test_one_large_group_takes_few_tasks(spark):
    """A group whose texts are all tied to their least and their greatest one, and some pairs, as near-dedup makes them."""
    edges = [(1000, k) for k in range(1001, 1400)] + [(k, 1400) for k in range(1001, 1400)] + [(k, k + 1) for k in range(0, 200, 2)]
    with settings(spark, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got, tasks = tasks_of(spark, lambda: found(spark, edges))
    assert got == brute_force(edges)
    assert 0 < tasks < 480, tasks  # 40 for each of a few shuffles


@pytest.mark.parametrize("few", [200_000, 0])
def test_chains_hubs_and_trees(spark, monkeypatch, few):
    monkeypatch.setattr(graphs, "BROADCAST_ROWS", few)
    monkeypatch.setattr(graphs, "few_rows", lambda rows: rows.count() <= few)
    rng = random.Random(4)
    order = rng.sample(range(1000, 1200), 200)
    edges = [(i, i + 1) for i in range(100)] + list(zip(order, order[1:])) + [(2300, i) for i in range(2000, 2100)] + [(3000 + i, 3000 + rng.randrange(i)) for i in range(1, 200)]
    assert found(spark, edges) == brute_force(edges)
