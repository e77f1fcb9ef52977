"""The numerical kernels: numpy arrays in, numpy arrays out, no Spark."""

from __future__ import annotations

import numpy as np


def window(n: int, kind: str | None) -> np.ndarray:
    """Symmetric hann or hamming weights; ones for any other kind."""
    kind = (kind or "").lower()
    return {"hann": np.hanning, "hanning": np.hanning, "hamming": np.hamming}.get(kind, np.ones)(n)


def samples(words: np.ndarray, lanes: int, n_samples: int, n_rx: int, chirps: int, interleaved: bool, real: bool = False, swap: bool = False, lane_order: list[int] | None = None, scale: float = 1.0) -> np.ndarray:
    """(frames, words) -> (frames, chirps, receivers, samples): groups of one word of each lane, for complex samples first all I and then all Q."""
    halves = 1 if real else 2
    order = lane_order if lane_order and len(lane_order) == lanes else list(range(lanes))
    parts = np.moveaxis(words.reshape(len(words), -1, halves, lanes)[..., order] / scale, 2, 0)
    parts = parts.reshape(halves, len(words), chirps, n_samples, n_rx).swapaxes(3, 4) if interleaved else parts.reshape(halves, len(words), chirps, n_rx, n_samples)
    if real:
        return parts[0]
    i, q = parts[::-1] if swap else parts
    return i + 1j * q


def spectrum(x: np.ndarray, n_fft: int, kind: str | None, remove_dc: bool, bins: int) -> np.ndarray:
    """Windowed DFT of rows, zero-padded or cut to n_fft, first `bins` bins."""
    if remove_dc:
        x = x - x.mean(axis=-1, keepdims=True)
    x = x * window(x.shape[-1], kind)
    return np.fft.fft(x, n=n_fft, axis=-1)[..., :bins]


def doppler(x: np.ndarray, n_fft: int, kind: str | None) -> np.ndarray:
    """(..., loops) -> shifted slow-time spectrum of the moving part."""
    x = (x - x.mean(axis=-1, keepdims=True)) * window(x.shape[-1], kind)
    return np.fft.fftshift(np.fft.fft(x, n=n_fft, axis=-1), axes=-1)


def ring_mean(grid: np.ndarray, guard: int, train: int) -> np.ndarray:
    """Mean of the training ring of all interior cells, from running sums; of each map, where there are several (..., rows, columns)."""
    w = guard + train
    total = np.zeros((*grid.shape[:-2], grid.shape[-2] + 1, grid.shape[-1] + 1))
    total[..., 1:, 1:] = grid.cumsum(-2).cumsum(-1)

    def box(half):
        a, b = w - half, w + half + 1
        rows, cols = grid.shape[-2] - 2 * w, grid.shape[-1] - 2 * w
        return total[..., b : b + rows, b : b + cols] - total[..., a : a + rows, b : b + cols] - total[..., b : b + rows, a : a + cols] + total[..., a : a + rows, a : a + cols]

    return (box(w) - box(guard)) / ((2 * w + 1) ** 2 - (2 * guard + 1) ** 2)


def _ring(guard: int, train: int) -> np.ndarray:
    side = 2 * (guard + train) + 1
    ring = np.ones((side, side), bool)
    ring[train : side - train, train : side - train] = False
    return ring


def ring_quantile(grid: np.ndarray, guard: int, train: int, share: float, cells: np.ndarray) -> np.ndarray:
    """The quantile of the training ring of the given interior cells (their rows and columns, 2 x n), interpolated as numpy's is; a block of cells at a time."""
    ring = _ring(guard, train)
    views = np.lib.stride_tricks.sliding_window_view(grid, ring.shape)
    block = max(1, (1 << 20) // ring.size)
    return np.concatenate([np.empty(0), *[np.quantile(views[cells[0, at : at + block], cells[1, at : at + block]][:, ring], share, axis=1) for at in range(0, cells.shape[1], block)]])


def above_quantile(grid: np.ndarray, guard: int, train: int, factor: float, share: float = 0.5) -> np.ndarray:
    """Interior cells above factor times the quantile of their ring.

    Ring values below cell / factor are counted, one shifted map for each place of
    the ring. Where the count is beyond both order statistics that the quantile
    lies between, it decides; only for the other cells the ring is sorted.
    """
    w = guard + train
    rows, cols = grid.shape[0] - 2 * w, grid.shape[1] - 2 * w
    inner = grid[w : w + rows, w : w + cols]
    places = np.argwhere(_ring(guard, train))
    position = share * (len(places) - 1)
    low, high = int(np.floor(position)), int(np.ceil(position))
    if factor <= 0:
        open_cells, hits = np.ones(inner.shape, bool), np.zeros(inner.shape, bool)
    else:
        scaled, below = factor * grid, np.zeros(inner.shape, np.int32)
        for r, c in places:
            below += scaled[r : r + rows, c : c + cols] < inner
        hits = below > high
        open_cells = ~hits & (below > low)
    at = np.stack(np.nonzero(open_cells))
    hits[open_cells] = inner[open_cells] > factor * ring_quantile(grid, guard, train, share, at)
    return hits


def detect(grid: np.ndarray, guard: int, train: int, factor: float, method: str = "average", share: float = 0.5) -> np.ndarray:
    """Cells above factor times their ring's mean, or its quantile (method ordered; 0.5: the median); cells nearer to an edge than the ring never are."""
    w = guard + train
    hits = np.zeros(grid.shape, bool)
    if min(grid.shape) > 2 * w:
        inner = (slice(w, grid.shape[0] - w), slice(w, grid.shape[1] - w))
        hits[inner] = above_quantile(grid, guard, train, factor, share) if method == "ordered" else grid[inner] > factor * ring_mean(grid, guard, train)
    return hits


def least_of_groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0 to n - 1 the least number of the group that the pairs (a, b) join it to."""
    root = np.arange(n)
    while True:
        new, least = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all() and (root[a] == root[b]).all():
            return root
        root = new


def label4(hits: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of the groups of hits that touch by an edge, in raster order of their first cells.

    Hits are taken in runs; runs of neighbouring rows that share a column are
    joined, each to the first run of its group, until nothing changes.
    """
    labels = np.zeros(hits.shape, np.int32)
    edges = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), end = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    n, width = len(row), hits.shape[1] + 1
    if not n:
        return labels
    first = np.searchsorted(row * width + end, (row + 1) * width + start, "right")
    many = np.maximum(np.searchsorted(row * width + start, (row + 1) * width + end, "left") - first, 0)
    a = np.repeat(np.arange(n), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    root = least_of_groups(n, a, b)
    own = np.unique(root, return_inverse=True)[1] + 1
    size = end - start
    labels.flat[np.repeat(row * hits.shape[1] + start - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(own, size)
    return labels


def steering(x: np.ndarray, sines: np.ndarray) -> np.ndarray:
    """(angles, antennas) phases of a plane wave over antenna places in wavelengths."""
    return np.exp(2j * np.pi * np.outer(sines, x))


def bartlett(snapshots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(bins, loops, antennas) -> (bins, angles): mean power of the Hamming-weighted beams."""
    beams = (snapshots * np.hamming(snapshots.shape[-1])) @ vectors.conj().T
    return (np.abs(beams) ** 2).mean(axis=1)


def capon(snapshots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(bins, loops, antennas) -> (bins, angles): minimum-variance power with diagonal loading; the mean amplitude of plain beams where loops are fewer than antennas."""
    loops, antennas = snapshots.shape[1:]
    if loops < antennas:
        return np.abs(snapshots @ vectors.conj().T).mean(axis=1)
    cov = np.swapaxes(snapshots.conj(), 1, 2) @ snapshots / loops
    load = 0.01 * np.trace(cov, axis1=1, axis2=2).real + 1e-9
    inverse = np.linalg.inv(cov + load[:, None, None] * np.eye(antennas))
    power = np.einsum("av,bvw,aw->ba", vectors, inverse, vectors.conj()).real
    return 1.0 / (power + 1e-12)
