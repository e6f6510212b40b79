"""Filters under masks of any radius, image by image in numpy: what a sample costs grows with the radius at most, never with its square.

A mask is given by its rows: for each row offset how far it reaches to both sides. Borders are repeated.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of the histograms that are held at a time.
HELD = 1 << 22


def by_image(f: Callable[[np.ndarray], np.ndarray], kind: str = "int") -> Column:
    """f of each image as rows of samples."""

    @F.pandas_udf(f"array<{kind}>")
    def made(width: pd.Series, data: pd.Series) -> pd.Series:
        dtype = {"int": np.int32, "long": np.int64, "double": np.float64}[kind]
        return pd.Series([None if d is None else f(np.asarray(d).reshape(-1, int(w))).ravel().astype(dtype) for w, d in zip(width, data)], dtype=object)

    return made("width", "data")


def reaches(offsets: list[tuple[int, int]]) -> list[tuple[int, int]] | None:
    """(row offset, reach) of a mask whose rows are whole and lie evenly around the middle; None for others."""
    rows: dict[int, list[int]] = {}
    for dy, dx in offsets:
        rows.setdefault(dy, []).append(dx)
    even = all(sorted(xs) == list(range(-max(xs), max(xs) + 1)) for xs in rows.values())
    return sorted((dy, max(xs)) for dy, xs in rows.items()) if even else None


def sliding_rank(image: np.ndarray, rows: list[tuple[int, int]], rank: int) -> np.ndarray:
    """The sample of a rank, from 0, under the mask: a histogram for each row of the image slides from left to right, all of them at once."""
    levels, values = np.unique(image, return_inverse=True)
    values, (h, w) = values.reshape(image.shape), image.shape
    far = max(reach for _, reach in rows)
    high = max(max(abs(dy) for dy, _ in rows), 0)
    wide = np.pad(values, ((high, high), (far, far + 1)), "edge")
    out, part = np.empty((h, w), np.int64), max(1, HELD // len(levels))
    for top in range(0, h, part):
        at = np.arange(top, min(top + part, h))
        counts = np.zeros((len(at), len(levels)), np.int32)
        line = np.arange(len(at))
        for dy, reach in rows:
            for x in range(far - reach, far + reach + 1):
                counts[line, wide[at + high + dy, x]] += 1
        for x in range(w):
            out[at, x] = (np.cumsum(counts, axis=1) > rank).argmax(axis=1)
            for dy, reach in rows:
                counts[line, wide[at + high + dy, x + far - reach]] -= 1
                counts[line, wide[at + high + dy, x + far + reach + 1]] += 1
    return levels[out]


def running(image: np.ndarray, reach: int, axis: int, pick: np.ufunc) -> np.ndarray:
    """pick over 2 reach + 1 samples along an axis, from picks over powers of two."""
    size = 2 * reach + 1
    wide = np.pad(image, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], "edge")
    step = 1
    while 2 * step <= size:
        n = wide.shape[axis] - step
        wide = pick(wide.take(range(n), axis), wide.take(range(step, n + step), axis))
        step *= 2
    n = image.shape[axis]
    return pick(wide.take(range(n), axis), wide.take(range(size - step, size - step + n), axis))


def extreme(image: np.ndarray, rows: list[tuple[int, int]], pick: np.ufunc) -> np.ndarray:
    """pick, maximum or minimum, under the mask."""
    (first, reach), (last, _) = rows[0], rows[-1]
    if -first == last and all(r == reach for _, r in rows):  # a rectangle: both directions on their own
        return running(running(image, reach, 1, pick), last, 0, pick)
    along = {r: running(image, r, 1, pick) for r in {r for _, r in rows}}
    h, found = len(image), None
    for dy, r in rows:
        there = along[r][np.clip(np.arange(h) + dy, 0, h - 1)]
        found = there if found is None else pick(found, there)
    return found


def weighed(image: np.ndarray, weights: list[tuple[int, int, float]]) -> np.ndarray:
    """Sums of samples by weights (row offset, column offset, weight): two passes where the weights are those of rows times those of columns, else one for all."""
    ry, rx = max(abs(dy) for dy, _, _ in weights), max(abs(dx) for _, dx, _ in weights)
    kernel = np.zeros((2 * ry + 1, 2 * rx + 1))
    for dy, dx, w in weights:
        kernel[dy + ry, dx + rx] += w
    wide = np.pad(image.astype(float), ((ry, ry), (rx, rx)), "edge")
    h, w = image.shape
    y, x = np.unravel_index(np.abs(kernel).argmax(), kernel.shape)
    column, row = kernel[:, x], kernel[y] / kernel[y, x] if kernel[y, x] else kernel[y]
    if np.allclose(np.outer(column, row), kernel, rtol=1e-12, atol=1e-15 * np.abs(kernel).max()):
        across = sum(row[k] * wide[:, k : k + w] for k in range(2 * rx + 1))
        return sum(column[k] * across[k : k + h] for k in range(2 * ry + 1))
    return sum(kernel[j, k] * wide[j : j + h, k : k + w] for j, k in zip(*np.nonzero(kernel)))


def box_sums(image: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares around each sample, from sums over all that is above and to the left."""
    wide = np.pad(image.astype(np.int64), radius, "edge")
    total = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k, (h, w) = 2 * radius + 1, image.shape
    return total[k : k + h, k : k + w] - total[:h, k : k + w] - total[k : k + h, :w] + total[:h, :w]


def block_means(image: np.ndarray, size: int) -> np.ndarray:
    """Means of size x size blocks, truncated; those at the right and lower edge may be smaller."""
    y, x = np.arange(0, image.shape[0], size), np.arange(0, image.shape[1], size)
    total = np.add.reduceat(np.add.reduceat(image.astype(np.int64), y, 0), x, 1)
    return total // np.outer(np.diff([*y, image.shape[0]]), np.diff([*x, image.shape[1]]))


def filtered(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    return images.withColumn("data", by_image(f))


def by_shape(f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """f of stacks of images of one shape: (images, rows, samples)."""

    @F.pandas_udf("array<int>")
    def made(width: pd.Series, data: pd.Series) -> pd.Series:
        out, shapes = np.empty(len(data), object), {}
        for k, (w, d) in enumerate(zip(width, data)):
            if d is not None:
                shapes.setdefault((len(d) // int(w) if w else 0, w), []).append(k)
        for shape, same in shapes.items():
            size = max(1, HELD // max(1, shape[0] * shape[1]) // 64)
            for at in range(0, len(same), size):
                some = same[at : at + size]
                for k, image in zip(some, f(np.stack([data[k] for k in some]).reshape(len(some), *map(int, shape)))):
                    out[k] = image.ravel().astype(np.int32)
        return pd.Series(out, dtype=object)

    return made("width", "data")


def bilateral(images: np.ndarray, sigma_s: float, sigma_r: float) -> np.ndarray:
    """Counts and sums of samples in buckets of (y, x, v), blurred by [1 2 1] / 4 twice along each axis; a sample is the quotient of both, read between its eight buckets.

    images are of one shape (images, rows, samples). Bucket rows are blurred and read a few at a time, so that what is held grows with a row of the images, not with their area.
    """
    n, h, w = images.shape
    if not images.size:
        return images
    low = int(np.floor(images.min() / sigma_r))
    levels, across, down = int(np.floor(images.max() / sigma_r)) - low + 2, int((w - 1) / sigma_s) + 2, int((h - 1) / sigma_s) + 2
    ys, xs, each, out = np.arange(h) / sigma_s, np.arange(w) / sigma_s, np.arange(n)[:, None, None], np.empty(images.shape, np.int64)
    part = min(down, max(1, HELD // (n * (across + 4) * (levels + 4)) - 5))
    for first in range(0, down, part):
        # Buckets first to first + part are read; two more on either side reach them.
        rows = np.flatnonzero((np.floor(ys + 0.5) >= first - 2) & (np.floor(ys + 0.5) <= first + part + 2))
        v, size = images[:, rows], (n, part + 5, across + 4, levels + 4)
        cell = (each, (np.floor(ys[rows] + 0.5).astype(np.int64) - first + 2)[:, None], np.floor(xs + 0.5).astype(np.int64) + 2, np.floor(v / sigma_r + 0.5).astype(np.int64) - low + 2)
        flat = np.ravel_multi_index(tuple(np.broadcast_arrays(*cell)), size).ravel()
        grids = [np.bincount(flat, some, int(np.prod(size))).reshape(size) for some in (None, v.ravel())]
        for axis in (1, 2, 3):
            grids = [blurred(blurred(g, axis), axis) for g in grids]
        mine = np.flatnonzero((np.floor(ys) >= first) & (np.floor(ys) < first + part))
        places = np.broadcast_arrays((ys[mine] - first + 2)[:, None], xs + 2, images[:, mine] / sigma_r - low + 2)
        floors = [np.floor(p).astype(np.int64) for p in places]
        sums, counts = np.zeros(places[0].shape), np.zeros(places[0].shape)
        for corner in np.ndindex(2, 2, 2):
            weight = 1.0
            for d, p, f in zip(corner, places, floors):
                weight = weight * (p - f if d else 1 - (p - f))
            at = (each, *(f + d for d, f in zip(corner, floors)))
            counts += weight * grids[0][at]
            sums += weight * grids[1][at]
        out[:, mine] = np.floor((sums / counts).round(6))
    return out


def blurred(grid: np.ndarray, axis: int) -> np.ndarray:
    """[1 2 1] / 4 along an axis, zeros outside."""
    out = grid / 2
    ahead, behind = (tuple(slice(*ends) if k == axis else slice(None) for k in range(grid.ndim)) for ends in ((1, None), (None, -1)))
    out[ahead] += grid[behind] / 4
    out[behind] += grid[ahead] / 4
    return out
