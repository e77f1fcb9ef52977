"""Percentiles by sketches that add up, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.functions import ranksketch

SHARES = [0.0, 0.05, 0.5, 0.731, 0.99, 1.0]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(6)
    return {"a": rng.normal(size=3000) * 20, "b": rng.integers(-3, 3, 500) / 4, "one": np.array([7.0]), "flat": np.ones(40), "wide": rng.normal(size=50) * 1e6}


@pytest.fixture(scope="module")
def rows(spark, values):
    data = [(c, k % 4, float(v), "x") for c, x in values.items() for k, v in enumerate(x)] + [("a", 0, None, "x"), ("a", 1, float("nan"), "x"), ("none", 0, None, "x")]
    return spark.createDataFrame(data, "capture_id string, day int, v double, cell string").repartition(5)


@pytest.mark.parametrize("step", [0.01, 1.0, 100.0])
def test_exact_percentiles(rows, values, step):
    got = {r.capture_id: r.p for r in ranksketch.exact(rows, F.col("v"), ranksketch.sketch(rows, F.col("v"), step), SHARES, step).collect()}
    assert got.keys() == values.keys()
    assert all(np.allclose(got[c], np.quantile(x, SHARES), atol=1e-9) for c, x in values.items())


def test_sketches_add_up_day_by_day(spark, rows, values, tmp_path):
    """Each day's sketch is stored and added to those before; what is asked for is between the bounds, and old rows aren't there to be read."""
    for day in range(4):
        ranksketch.sketch(rows.where(F.col("day") == day), F.col("v"), 0.5).write.parquet(f"{tmp_path}/day={day}")
        seen = [spark.read.parquet(f"{tmp_path}/day={d}") for d in range(day + 1)]
        found = {r.capture_id: r.p for r in ranksketch.bounds(ranksketch.merged(*seen), SHARES, 0.5).collect()}
        for c, x in values.items():
            x = x[np.arange(len(x)) % 4 <= day]
            p = np.quantile(x, SHARES)
            assert all(b.low <= v <= b.high for v, b in zip(p, found[c]))
            assert all(b.high - b.low <= 0.5 + 1e-9 for b in found[c]) or c == "wide" or len(x) < 2 or c in ("a", "b")
    whole = ranksketch.merged(*seen)
    same = ranksketch.sketch(rows, F.col("v"), 0.5)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, same.collect()))
    got = {r.capture_id: r.p for r in ranksketch.exact(rows, F.col("v"), whole, SHARES, 0.5).collect()}
    assert all(np.allclose(got[c], np.quantile(x, SHARES)) for c, x in values.items())


def test_no_values(rows):
    none = rows.where("false")
    assert ranksketch.exact(none, F.col("v"), ranksketch.sketch(none, F.col("v"), 1.0), SHARES, 1.0).count() == 0
    assert ranksketch.bounds(ranksketch.sketch(none, F.col("v"), 1.0), SHARES, 1.0).count() == 0
