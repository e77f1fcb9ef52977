"""Maps in tiles against the same maps as a whole."""

import numpy as np
import pandas as pd
import pytest

from sweepframe.functions import kernels
from sweepframe.functions.groups import in_groups
from sweepframe.operators import detection, tiles

CELLS = "extra string, capture_id string, frame int, doppler_idx int, range_idx int, mag double"


def cells_of(maps):
    return [("x", c, f, d, r, float(m)) for (c, f), grid in maps.items() for (d, r), m in np.ndenumerate(grid)]


def rows_of(df):
    return {(r.capture_id, r.frame, r.doppler_idx, r.range_idx): (r.mag, r.label) for r in df.collect()}


def whole(maps, *parameters):
    found = {}
    for key, grid in maps.items():
        for r in detection.hits_of(key, grid, *parameters).itertuples(index=False):
            found[r.capture_id, r.frame, r.doppler_idx, r.range_idx] = (r.mag, r.label)
    return found


def spiral(n):
    """One line that winds through all tiles, on a low ground, with single cells in its gaps."""
    grid = np.full((n, n), 0.1)
    d = r = n // 2
    step, way = 4, 0
    grid[d, r] = 9
    while True:
        for _ in range(2):
            for _ in range(step):
                d, r = d + (0, 1, 0, -1)[way % 4], r + (1, 0, -1, 0)[way % 4]
                if not (1 <= d < n - 1 and 1 <= r < n - 1):
                    return grid
                grid[d, r] = 9
            way += 1
        step += 4


@pytest.mark.parametrize("tile", [(5, 7), (16, 3), (1, 1), (64, 64)])
def test_tiles_label_as_whole_maps(spark, tile):
    rng = np.random.default_rng(11)
    maps = {("a", 0): rng.exponential(size=(23, 37)), ("a", 1): rng.exponential(size=(4, 9)), ("b", 0): rng.exponential(size=(31, 18)), ("b", 7): np.ones((12, 12)), ("c", 0): spiral(30)}
    if tile == (1, 1):
        maps = {k: v for k, v in maps.items() if k in (("a", 1), ("b", 0))}
    cells = spark.createDataFrame(cells_of(maps), CELLS)
    for parameters in ((1, 2, 0.9, "average", 0.5), (1, 1, 1.1, "ordered", 0.6)):
        got, expected = rows_of(tiles.cfar(cells, *parameters[:4], share=parameters[4], tile=tile)), whole(maps, *parameters)
        assert got == expected and len(got) > 50


def test_a_cluster_through_all_tiles(spark):
    grid = spiral(41)
    found = tiles.cfar(spark.createDataFrame(cells_of({("s", 0): grid}), CELLS), 0, 1, 1.5, tile=(4, 6))
    assert found.columns == ["capture_id", "frame", "doppler_idx", "range_idx", "mag", "label"]
    got = rows_of(found)
    assert got == whole({("s", 0): grid}, 0, 1, 1.5, "average")
    assert len({(d // 4, r // 6) for _, _, d, r in got}) > 30


def test_odd_tables(spark):
    rng = np.random.default_rng(3)
    grid = rng.exponential(size=(14, 15))
    rows = cells_of({("a", 0): grid})
    expected = whole({("a", 0): grid}, 1, 1, 0.9, "average")
    assert rows_of(tiles.cfar(spark.createDataFrame(rows, CELLS).where("false"), 1, 1, 0.9, tile=(5, 5))) == {}
    # repeated cells, cells without a place, a map of nulls alone
    more = [*rows, *rows[:40], ("x", "a", 0, 5, 5, -1.0), ("x", None, 0, 1, 1, 5.0), ("x", "a", None, 1, 1, 5.0), ("x", "a", 0, None, 1, 5.0), ("x", "a", 0, -1, 1, 5.0), ("x", "b", 0, 1, 1, None)]
    assert rows_of(tiles.cfar(spark.createDataFrame(more, CELLS), 1, 1, 0.9, tile=(5, 5))) == expected
    # a missing, a null and a NaN cell: no cell whose ring box reaches them is a hit, the others are as before
    for gap in ([], [("x", "a", 0, 6, 7, None)], [("x", "a", 0, 6, 7, float("nan"))]):
        kept = [r for r in rows if r[3:5] != (6, 7)] + gap
        got = rows_of(tiles.cfar(spark.createDataFrame(kept, CELLS), 1, 1, 0.9, tile=(5, 5)))
        assert got.keys() == {k for k in expected if max(abs(k[2] - 6), abs(k[3] - 7)) > 2}
    with pytest.raises(ValueError):
        tiles.cfar(spark.createDataFrame(rows, CELLS), method="other")


def test_least_of_groups():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, 45), rng.integers(0, 60, 45)
    expected = list(range(60))
    for _ in range(60):
        for x, y in zip(a, b):
            expected[x] = expected[y] = min(expected[x], expected[y])
    assert kernels.least_of_groups(60, a, b).tolist() == expected


def test_small_tiles_travel_together(spark, monkeypatch):
    """A cell is sent to one block of tiles or a few, not to each small tile that its value reaches."""
    sent = []
    monkeypatch.setattr(tiles, "in_groups", lambda rows, keys, *how: sent.append(rows.count()) or in_groups(rows, keys, *how))
    grid = np.random.default_rng(5).exponential(size=(16, 32))
    cells = spark.createDataFrame(cells_of({("a", f): grid for f in range(3)}), CELLS)
    assert len(rows_of(tiles.cfar(cells, 1, 2, 1.8, tile=(5, 7)))) > 50
    assert sent[0] == 3 * grid.size


def test_whole_groups_in_few_calls(spark):
    rows = spark.createDataFrame([(k % 7 or None, f"c{k % 3}", k) for k in range(500)], "a int, b string, v int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")

    def sums(rows, bounds):
        return pd.DataFrame([(*rows.iloc[a][["a", "b"]], rows["v"][a:b].sum(), rows["v"][a:b].count(), a) for a, b in zip(bounds, bounds[1:])], columns=["a", "b", "total", "n", "place"])

    try:
        found = in_groups(rows, ["a", "b"], sums, "a double, b string, total long, n long, place long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((0 if r.a is None or r.a != r.a else int(r.a), r.b, r.total, r.n) for r in found)
    assert got == sorted((a, f"c{b}", sum(k for k in range(500) if k % 7 == a and k % 3 == b), sum(k % 7 == a and k % 3 == b for k in range(500))) for a in range(7) for b in range(3))
    assert any(r.place for r in found)
