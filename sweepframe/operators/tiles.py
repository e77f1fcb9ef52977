"""CFAR and clusters of maps that no task holds whole.

A map is cut into tiles; a tile is detected with the cells around it that rings
reach, and its own hits are labelled; small tiles are sent in blocks. Clusters that touch across a border are
joined level by level: first within squares of 2 x 2 tiles, then of 4 x 4, and
so on, so a group holds the links across the middle lines of one square, at
most about its sides. A cluster's name is the place of its first cell, so
numbering the names gives the labels of the whole map, in raster order.

Defined results: cells without a capture, a frame, or a place take no part, nor
do those with a negative place; of repeated cells the greatest counts; a cell
whose ring reaches beyond the map, or to a missing, null or NaN cell, is never a
hit; an empty table gives no row; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions import kernels
from sweepframe.functions.groups import in_groups
from sweepframe.functions.scratch import materialise
from sweepframe.operators import longseries

#: Cells along each side of a tile.
TILE = (512, 512)
#: A place in raster order is doppler_idx * ROW + range_idx.
ROW = 1 << 32
_MAP = ["capture_id", "frame"]


def _detected(grid: np.ndarray, tile: tuple[int, int], guard: int, train: int, factor: float, method: str, share: float) -> np.ndarray:
    """Hits of the tiles that lie in a grid with the cells around it, each from its own cells and those that its rings reach."""
    w, (high, wide) = guard + train, tile
    known = ~np.isnan(grid)
    filled, hits = np.where(known, grid, 0.0), np.zeros((grid.shape[0] - 2 * w, grid.shape[1] - 2 * w), bool)
    for top in range(0, len(hits), high):
        row = np.lib.stride_tricks.sliding_window_view(filled[top : top + high + 2 * w], wide + 2 * w, axis=1)[:, ::wide].swapaxes(0, 1)
        if method == "ordered":
            found = np.stack([kernels.detect(x, guard, train, factor, method, share)[w : w + high, w : w + wide] for x in row])
        else:
            found = row[:, w : w + high, w : w + wide] > factor * kernels.ring_mean(row, guard, train)
        hits[top : top + high] = found.swapaxes(0, 1).reshape(high, -1)
    if not known.all():
        sums = np.pad(known, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        side = 2 * w + 1
        hits &= sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side] == side * side
    return hits


def _found(cells: DataFrame, tile: tuple[int, int], guard: int, train: int, factor: float, method: str, share: float) -> DataFrame:
    """Hits of all tiles: capture_id, frame, doppler_idx, range_idx, mag, and name, the place of the first cell of the cluster within the tile.

    Small tiles travel together, in blocks of as many as a tile of TILE cells has room for, so cells are sent to few groups whatever the tile.
    """
    w, (high, wide) = guard + train, tile
    sides = tuple(max(1, most // side) * side for most, side in zip(TILE, tile))
    kinds = {c: cells.schema[c].dataType.simpleString() for c in _MAP}

    def reach(at: str, side: int):
        """Numbers of the blocks whose rings reach a cell."""
        return F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - w) / side)), F.floor((F.col(at) + w) / side)))

    def one(top: int, left: int, d: np.ndarray, r: np.ndarray, mag: np.ndarray) -> tuple[np.ndarray, ...]:
        d, r = d - top, r - left
        # whole tiles, up to the last with a cell
        rows, cols = (min(most, max(0, int(at.max())) // side * side + side) for most, at, side in zip(sides, (d, r), tile))
        grid = np.full((rows + 2 * w, cols + 2 * w), np.nan)
        np.fmax.at(grid, (d + w, r + w), mag)
        hits = _detected(grid, tile, guard, train, factor, method, share)
        # an empty line after each tile keeps clusters of different tiles apart
        y, x = np.arange(rows) + np.arange(rows) // high, np.arange(cols) + np.arange(cols) // wide
        apart = np.zeros((rows + rows // high, cols + cols // wide), bool)
        apart[y[:, None], x] = hits
        d, r = np.nonzero(hits)
        label = kernels.label4(apart)[y[d], x[r]]
        place = (d + top) * ROW + r + left
        first = np.full(label.max(initial=0) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, label, place)
        return d + top, r + left, grid[d + w, r + w], first[label]

    def many(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        d, r, mag = rows["doppler_idx"].to_numpy(np.int64), rows["range_idx"].to_numpy(np.int64), rows["mag"].to_numpy(float)
        tops, lefts = rows["__top"].to_numpy(np.int64) * sides[0], rows["__left"].to_numpy(np.int64) * sides[1]
        found = [one(tops[a], lefts[a], d[a:b], r[a:b], mag[a:b]) for a, b in zip(bounds, bounds[1:])]
        at = np.repeat(bounds[:-1], [len(x[0]) for x in found])
        return pd.DataFrame({c: rows[c].to_numpy()[at] for c in _MAP} | {c: np.concatenate(x) for c, x in zip(("doppler_idx", "range_idx", "mag", "name"), zip(*found))})

    good = cells.select(*_MAP, F.col("doppler_idx").cast("long").alias("doppler_idx"), F.col("range_idx").cast("long").alias("range_idx"), F.col("mag").cast("double").alias("mag")).dropna().where("doppler_idx >= 0 and range_idx >= 0")
    spread = good.withColumn("__top", reach("doppler_idx", sides[0])).withColumn("__left", reach("range_idx", sides[1]))
    schema = ", ".join(f"{c} {kinds[c]}" for c in _MAP) + ", doppler_idx long, range_idx long, mag double, name long"
    return in_groups(spread, [*_MAP, "__top", "__left"], many, schema)


def _links(hits: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """Pairs of names (a, b) of neighbouring cells on both sides of a border, with the level of the smallest square of tiles that holds both."""
    high, wide = tile
    d, r = F.col("doppler_idx"), F.col("range_idx")
    here = hits.where((d % high == 0) | (r % wide == 0))
    up = here.where(d % high == 0).select(*_MAP, (d - 1).alias("doppler_idx"), "range_idx", d.alias("d"), r.alias("r"), F.col("name").alias("a"))
    back = here.where(r % wide == 0).select(*_MAP, "doppler_idx", (r - 1).alias("range_idx"), d.alias("d"), r.alias("r"), F.col("name").alias("a"))
    ends = hits.where((d % high == high - 1) | (r % wide == wide - 1)).select(*_MAP, "doppler_idx", "range_idx", F.col("name").alias("b"))
    across = lambda one, other, side: F.floor(F.col(one) / side).bitwiseXOR(F.floor(F.col(other) / side))
    level = F.length(F.bin(across("d", "doppler_idx", high).bitwiseOR(across("r", "range_idx", wide))))
    square = [F.floor(F.col(at) / side).alias(into) for at, side, into in (("d", high, "top"), ("r", wide, "left"))]
    return up.unionAll(back).join(ends, [*_MAP, "doppler_idx", "range_idx"]).select(*_MAP, *square, level.alias("level"), "a", "b").distinct()


def _joined(links: DataFrame) -> DataFrame:
    """(capture_id, frame, name, root) of all clusters that touch a border, root being the smallest name of what they are part of."""
    root = materialise(links.select(*_MAP, F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("root", F.col("name")))
    schema = ", ".join(f"{c} {links.schema[c].dataType.simpleString()}" for c in _MAP) + ", old long, new long"

    def join(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        squares = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        names = np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()])
        # a name of one square has one number, smaller names smaller ones
        order = np.lexsort((names, np.tile(squares, 2)))
        sorted_, square = names[order], np.tile(squares, 2)[order]
        new = np.append(True, (sorted_[1:] != sorted_[:-1]) | (square[1:] != square[:-1]))
        at = np.empty(len(names), np.int64)
        at[order] = np.cumsum(new) - 1
        old, first = sorted_[new], bounds[square[new]]
        least = kernels.least_of_groups(len(old), at[: len(rows)], at[len(rows) :])
        moved = np.flatnonzero(least != np.arange(len(old)))
        return pd.DataFrame({c: rows[c].to_numpy()[first[moved]] for c in _MAP} | {"old": old[moved], "new": old[least[moved]]})

    for level in range(1, (links.agg(F.max("level")).first()[0] or 0) + 1):
        now = links.where(F.col("level") == level)
        for end in ("a", "b"):
            now = now.join(root.select(*_MAP, F.col("name").alias(end), F.col("root").alias(f"__{end}")), [*_MAP, end])
        now = now.select(*_MAP, F.shiftright("top", level).alias("top"), F.shiftright("left", level).alias("left"), F.col("__a").alias("a"), F.col("__b").alias("b")).where("a != b").distinct()
        new = in_groups(now, [*_MAP, "top", "left"], join, schema).withColumnRenamed("old", "root")
        root = materialise(root.join(new, [*_MAP, "root"], "left").select(*_MAP, "name", F.coalesce("new", "root").alias("root")))
    return root


def cfar(cells: DataFrame, guard: int = 2, train: int = 8, factor: float = 3.0, method: str = "average", share: float = 0.5, tile: tuple[int, int] = TILE) -> DataFrame:
    """(capture_id, frame, doppler_idx, range_idx, mag, label) of the detected cells, as detection.cfar gives them, for maps given by cell in mag and taken in tiles of so many Doppler and range cells."""
    if method not in ("average", "ordered"):
        raise ValueError(f"no such method: {method}")
    if min(tile) < 1:
        raise ValueError("a tile has at least one cell")
    hits = materialise(_found(cells, tile, guard, train, factor, method, share))
    root = _joined(materialise(_links(hits, tile)))
    named = materialise(hits.join(root, [*_MAP, "name"], "left").withColumn("root", F.coalesce("root", "name")).drop("name"))
    # a block of numbering is a row of tiles
    labels = longseries.positions(named.select(*_MAP, "root").distinct(), _MAP, "root", "__label", block=tile[0] * ROW)
    found = named.join(labels, [*_MAP, "root"])
    return found.select(*_MAP, F.col("doppler_idx").cast("int").alias("doppler_idx"), F.col("range_idx").cast("int").alias("range_idx"), "mag", (F.col("__label") + 1).cast("int").alias("label"))
