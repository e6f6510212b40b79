"""Operators whose samples depend on their neighbours.

Small kernels and masks are expressions over the row's own array, with borders repeated; larger ones, and box sums and their
kin over any radius, are computed in numpy inside the row (see masks). No pixel is shuffled for either.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators import masks
from quillframe.operators.geometry import downscale_pow2, upscale_pow2
from quillframe.sources.images import at, clamped, from_pixels, inside, pixels, settled

Kernel = list[tuple[int, int, float]]

#: Farther than any place of an image.
FAR = 1 << 40
#: Masks of more places aren't expressions any more.
SMALL = 25


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def circle(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in square(radius) if dy * dy + dx * dx <= radius * radius]


def normalised(weights: Kernel) -> Kernel:
    total = sum(w for _, _, w in weights)
    return [(dy, dx, w / total) for dy, dx, w in weights]


def rect_kernel(ry: int, rx: int) -> Kernel:
    return normalised([(dy, dx, 1.0) for dy in range(-ry, ry + 1) for dx in range(-rx, rx + 1)])


def circle_kernel(radius: int) -> Kernel:
    return normalised([(dy, dx, 1.0) for dy, dx in circle(radius)])


def gauss_kernel(radius: int, sigmas: float = 3.0) -> Kernel:
    """sigma is radius / sigmas."""
    s2 = 2 * (radius / sigmas) ** 2
    return normalised([(dy, dx, math.exp(-(dy * dy + dx * dx) / s2)) for dy, dx in square(radius)])


def laplace_kernel() -> Kernel:
    return [(0, 0, 4.0), (-1, 0, -1.0), (1, 0, -1.0), (0, -1, -1.0), (0, 1, -1.0)]


def log_kernel(radius: int, sigmas: float = 3.0) -> Kernel:
    """Laplacian of a Gaussian."""
    s2 = (radius / sigmas) ** 2
    return [(dy, dx, -(1 - (dy * dy + dx * dx) / (2 * s2)) * math.exp(-(dy * dy + dx * dx) / (2 * s2)) / (math.pi * s2 * s2)) for dy, dx in square(radius)]


def weighted(y: Column, x: Column, kernel: Kernel) -> Column:
    terms = [clamped(y + dy, x + dx) * F.lit(float(w)) for dy, dx, w in kernel]
    return F.aggregate(F.array(*terms), F.lit(0.0), lambda s, v: s + v)


def convolve(images: DataFrame, kernel: Kernel, integer: bool = True) -> DataFrame:
    """Borders repeated; whole samples are truncated and kept in range."""
    if len(kernel) > SMALL:
        if not integer:
            return images.withColumn("data", masks.by_image(lambda image: masks.weighed(image, kernel).round(9), "double"))
        return masks.filtered(images, lambda image: np.trunc(masks.weighed(image, kernel).round(9)).clip(0, 255))

    def value(y: Column, x: Column) -> Column:
        v = F.round(weighted(y, x, kernel), 9)
        return F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(255)) if integer else v

    return from_pixels(images, value)


def ordered(images: DataFrame, offsets: list[tuple[int, int]], pick) -> DataFrame:
    """pick of the sorted samples under a mask."""
    return from_pixels(images, lambda y, x: pick(F.sort_array(F.array(*[clamped(y + dy, x + dx) for dy, dx in offsets]))))


def median_filter(images: DataFrame, radius: int, shape=square) -> DataFrame:
    """The sample of rank n div 2, from 0, of n under the mask."""
    offsets = shape(radius)
    rows = masks.reaches(offsets)
    if len(offsets) > SMALL and rows:
        n = len(offsets)
        return masks.filtered(images, lambda image: masks.sliding_rank(image, rows, n // 2))
    return ordered(images, offsets, lambda a: F.get(a, F.lit(len(offsets) // 2)))


def extreme_filter(images: DataFrame, offsets: list[tuple[int, int]], most: bool) -> DataFrame:
    rows = masks.reaches(offsets)
    if len(offsets) > SMALL and rows:
        return masks.filtered(images, lambda image: masks.extreme(image, rows, np.maximum if most else np.minimum))
    return ordered(images, offsets, F.array_max if most else F.array_min)


def max_filter(images: DataFrame, radius: int, shape=square) -> DataFrame:
    return extreme_filter(images, shape(radius), True)


def min_filter(images: DataFrame, radius: int, shape=square) -> DataFrame:
    return extreme_filter(images, shape(radius), False)


def box(images: DataFrame, radius: int) -> DataFrame:
    """(image_id, y, x, v, n, s, s2): count, sum and sum of squares of the samples around, borders repeated."""
    sums = masks.by_image(lambda image: masks.box_sums(image, radius), "long")
    squares = masks.by_image(lambda image: masks.box_sums(image.astype(np.int64) ** 2, radius), "long")
    rows = settled(images.select("image_id", "width", "data", sums.alias("s"), squares.alias("s2")))
    rows = rows.select("image_id", "width", F.posexplode(F.arrays_zip(F.col("data").alias("v"), "s", "s2")).alias("at", "c"))
    return rows.select("image_id", F.expr("at div width").cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), "c.v", F.lit((2 * radius + 1) ** 2).alias("n"), "c.s", "c.s2")


def box_mean(images: DataFrame, radius: int) -> DataFrame:
    return box(images, radius).select("image_id", "y", "x", F.expr("s div n").cast("int").alias("v"))


def local_variance(images: DataFrame, radius: int) -> DataFrame:
    return box(images, radius).select("image_id", "y", "x", F.expr("(n * s2 - s * s) / (n * n * 1.0d)").alias("variance"))


def niblack(images: DataFrame, radius: int = 7, k: float = -0.2) -> DataFrame:
    mean, sd = F.expr("s / n"), F.sqrt(F.expr("(n * s2 - s * s) / (n * n * 1.0d)"))
    return box(images, radius).select("image_id", "y", "x", F.when(F.col("v") < F.round(mean + F.lit(k) * sd, 9), 0).otherwise(255).alias("v"))


def sauvola(images: DataFrame, radius: int = 7, r: float = 128.0, k: float = 0.5) -> DataFrame:
    mean, sd = F.expr("s / n"), F.sqrt(F.expr("(n * s2 - s * s) / (n * n * 1.0d)"))
    return box(images, radius).select("image_id", "y", "x", F.when(F.col("v") < F.round(mean * (1 + F.lit(k) * (sd / F.lit(r) - 1)), 9), 0).otherwise(255).alias("v"))


def morphology(images: DataFrame, grow: bool) -> DataFrame:
    """Ink (0) grown or shrunk by 3 x 3; what is outside doesn't count."""

    def value(y: Column, x: Column) -> Column:
        near = F.array_compact(F.array(*[F.when(inside(y + dy, x + dx), at(y + dy, x + dx)) for dy, dx in square(1)]))
        return F.array_min(near) if grow else F.array_max(near)

    return from_pixels(images, value)


#: Horizontal and vertical gradients, as weights by row and column offset. Fixed values.
SOBEL = ([(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)], [(-1, -1, -1), (-1, 0, -2), (-1, 1, -1), (1, -1, 1), (1, 0, 2), (1, 1, 1)])
PREWITT = ([(-1, -1, -1), (-1, 1, 1), (0, -1, -1), (0, 1, 1), (1, -1, -1), (1, 1, 1)], [(-1, -1, -1), (-1, 0, -1), (-1, 1, -1), (1, -1, 1), (1, 0, 1), (1, 1, 1)])


def gradient(y: Column, x: Column, weights: list[tuple[int, int, int]]) -> Column:
    terms = [clamped(y + dy, x + dx) * w for dy, dx, w in weights]
    return sum(terms[1:], terms[0])


def edges(images: DataFrame, operator=SOBEL, part: str = "magnitude") -> DataFrame:
    """part: magnitude; dx or dy (absolute); dx_signed or dy_signed (around 128); direction, in radians."""
    along = lambda y, x: gradient(y, x, operator[0])
    down = lambda y, x: gradient(y, x, operator[1])
    top = lambda v: F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(255))
    value = {
        "magnitude": lambda y, x: top(F.floor(F.sqrt((along(y, x) * along(y, x) + down(y, x) * down(y, x)).cast("double")) + 0.5)),
        "dx": lambda y, x: top(F.abs(along(y, x))), "dy": lambda y, x: top(F.abs(down(y, x))),
        "dx_signed": lambda y, x: top(128 + along(y, x)), "dy_signed": lambda y, x: top(128 + down(y, x)),
        "direction": lambda y, x: F.round(F.atan2(down(y, x).cast("double"), along(y, x).cast("double")), 6),
    }[part]
    return from_pixels(images, value)


def rgb_edges(planes: DataFrame, operator=SOBEL) -> DataFrame:
    """planes has the samples of three channels as red, green and blue; data is their magnitudes' length, scaled to 0 to 255 and truncated."""
    colours = ("red", "green", "blue")
    for c in colours:
        planes = edges(planes.withColumn("data", F.col(c)), operator).drop(c).withColumnRenamed("data", c)
    length = F.transform(F.arrays_zip(*colours), lambda p: F.sqrt(sum((p[c] * p[c] for c in colours[1:]), p[colours[0]] * p[colours[0]]).cast("double") / 3))
    return planes.withColumn("data", F.transform(length, lambda v: F.floor(F.round(v, 9)).cast("int"))).drop(*colours)


def edge_directions(direction: Column, half: bool = True) -> Column:
    """Gradient directions turned by a quarter into edge directions, in [0, pi) or [0, 2 pi)."""
    return F.pmod(direction - math.pi / 2, F.lit(math.pi if half else 2 * math.pi))


def laplace_zeros(images: DataFrame) -> DataFrame:
    """255 where the 3 x 3 Laplacian changes sign against the left, upper or upper left neighbour and is the nearer to 0."""
    lap = lambda y, x: 4 * clamped(y, x) - clamped(y - 1, x) - clamped(y + 1, x) - clamped(y, x - 1) - clamped(y, x + 1)

    def value(y: Column, x: Column) -> Column:
        here = lap(y, x)
        crossed = F.lit(False)
        for dy, dx in ((0, -1), (-1, 0), (-1, -1), (0, 1), (1, 0), (1, 1)):
            other = lap(y + dy, x + dx)
            nearer = F.abs(here) <= F.abs(other) if (dy, dx) < (0, 0) else F.abs(here) < F.abs(other)
            crossed = crossed | (inside(y + dy, x + dx) & (here * other < 0) & nearer)
        return F.when(crossed, 255).otherwise(0)

    return from_pixels(images, value)


def non_max_suppression(images: DataFrame, operator=SOBEL) -> DataFrame:
    """The gradient's magnitude where neither neighbour across the edge exceeds it: left and right for mostly horizontal gradients, else above and below."""

    def value(y: Column, x: Column) -> Column:
        size = lambda yy, xx: gradient(yy, xx, operator[0]) * gradient(yy, xx, operator[0]) + gradient(yy, xx, operator[1]) * gradient(yy, xx, operator[1])
        part = lambda yy, xx: F.when(inside(yy, xx), size(yy, xx)).otherwise(0)
        flat = F.abs(gradient(y, x, operator[0])) >= F.abs(gradient(y, x, operator[1]))
        here = size(y, x)
        stays = F.when(flat, (here >= part(y, x - 1)) & (here >= part(y, x + 1))).otherwise((here >= part(y - 1, x)) & (here >= part(y + 1, x)))
        return F.when(stays, F.least(F.floor(F.sqrt(here.cast("double")) + 0.5), F.lit(255)).cast("int")).otherwise(0)

    return from_pixels(images, value)


def l1_distances(on: np.ndarray) -> np.ndarray:
    """L1 distance of each place to the nearest one that is on, FAR or more where none is: running minima along the last two axes, both ways."""
    d = np.where(on, 0, FAR)
    for axis in (-2, -1):
        i = np.arange(on.shape[axis]).reshape([-1 if k == axis else 1 for k in (-2, -1)])
        ahead = np.minimum.accumulate(d - i, axis) + i
        behind = np.flip(np.minimum.accumulate(np.flip(d + i, axis), axis), axis) - i
        d = np.minimum(ahead, behind)
    return d


def distance_map(images: DataFrame, most: int = 240, least: int = -12) -> DataFrame:
    """Background: L1 distance to ink (0). Ink: minus its distance to background, plus 1. Kept between least and most.

    In numpy, image by image: running minima take the same few passes however much ink there is, and nothing is shuffled.
    """

    @F.pandas_udf("array<int>")
    def signed(width: pd.Series, data: pd.Series) -> pd.Series:
        def one(w: int, samples: np.ndarray) -> np.ndarray:
            ink = np.asarray(samples).reshape(-1, int(w)) == 0
            return np.where(ink, 1 - l1_distances(~ink), l1_distances(ink)).clip(least, most).ravel()

        return pd.Series([None if d is None else one(w, d) for w, d in zip(width, data)], dtype=object)

    return images.withColumn("data", signed("width", "data"))


def medial_axis(distances: DataFrame, thin: bool = True) -> DataFrame:
    """0 on the axis, 255 elsewhere: ink whose distance is least among itself and its four neighbours; thin drops the lower right of full 2 x 2 squares."""
    big = F.lit(1 << 20)
    get = lambda y, x: F.when(inside(y, x), at(y, x)).otherwise(big)

    def axis(y: Column, x: Column) -> Column:
        d = get(y, x)
        return (d <= 0) & (d <= get(y - 1, x)) & (d <= get(y + 1, x)) & (d <= get(y, x - 1)) & (d <= get(y, x + 1))

    marked = from_pixels(distances, lambda y, x: F.when(axis(y, x), 0).otherwise(255))
    if not thin:
        return marked
    on = lambda y, x: F.when(inside(y, x), at(y, x) == 0).otherwise(F.lit(False))
    return from_pixels(marked, lambda y, x: F.when(on(y, x) & ~(on(y - 1, x) & on(y, x - 1) & on(y - 1, x - 1)), 0).otherwise(255))


#: The eight places around one, clockwise from above it.
AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def thinning_table() -> np.ndarray:
    """Whether ink goes, by subiteration and by which of AROUND are ink.

    It goes where it joins nothing (one run of ink around it), ends no line (two or three pairs of neighbours have ink) and lies
    on the side that the subiteration peels: north and east, then south and west.
    """
    goes = np.zeros((2, 256), bool)
    for code in range(256):
        n, ne, e, se, s, sw, w, nw = (bool(code >> k & 1) for k in range(8))
        runs = (not n and (ne or e)) + (not e and (se or s)) + (not s and (sw or w)) + (not w and (nw or n))
        pairs = min((nw or n) + (ne or e) + (se or s) + (sw or w), (n or ne) + (e or se) + (s or sw) + (w or nw))
        for k, side in enumerate(((n or ne or not se) and e, (s or sw or not nw) and w)):
            goes[k, code] = runs == 1 and pairs in (2, 3) and not side
    return goes


def thinned(ink: np.ndarray) -> np.ndarray:
    """A skeleton one sample wide, with as many components: two subiterations by turns, each for all places at once, until neither takes any."""
    table, on, idle, k = thinning_table(), np.pad(ink, 1), 0, 0
    while idle < 2:
        code = np.zeros(on.shape, np.uint8)
        for bit, (dy, dx) in enumerate(AROUND):
            code |= np.roll(on, (-dy, -dx), (0, 1)).astype(np.uint8) << bit
        gone = on & table[k % 2][code]
        on, idle, k = on & ~gone, 0 if gone.any() else idle + 1, k + 1
    return on[1:-1, 1:-1]


def skeleton(images: DataFrame) -> DataFrame:
    """255 on the skeleton of ink (0), 0 elsewhere."""

    @F.pandas_udf("array<int>")
    def thin(width: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else np.where(thinned(np.asarray(d).reshape(-1, int(w)) == 0), 255, 0).ravel().astype(np.int32) for w, d in zip(width, data)], dtype=object)

    return images.withColumn("data", thin("width", "data"))


def bilateral(images: DataFrame, sigma_s: float, sigma_r: float) -> DataFrame:
    """(image_id, y, x, v): a bilateral grid of buckets, blurred by [1 2 1] / 4 twice along each axis, read between eight buckets. The grid is one of its image's row."""
    filtered = masks.by_shape(lambda some: masks.bilateral(some, sigma_s, sigma_r))
    return pixels(images.withColumn("data", filtered))


def remove_background(images: DataFrame, radius: int) -> DataFrame:
    """The median filter is the background."""
    return without_background(images.join(median_filter(images, radius).select("image_id", F.col("data").alias("_back")), "image_id"))


def remove_low_res_background(images: DataFrame, radius: int | None = None, least: tuple[int, int] = (100, 100), most: tuple[int, int] = (800, 800)) -> DataFrame:
    """The background of large images is found at a low resolution: halved while both sides are larger than least and one larger than most
    (width, height), the median filter, grown again and smoothed by a box with as many halvings as radius. Without a
    radius it is 3 / 200 of the longer low side. Images that aren't halved are treated as by remove_background.
    """
    w, h = "shiftright(width, n)", "shiftright(height, n)"
    enough = f"not ({w} > {least[0]} and {h} > {least[1]} and ({w} > {most[0]} or {h} > {most[1]}))"
    sized = images.withColumn("_halves", F.expr(f"cast(array_position(transform(sequence(0, 30), n -> {enough}), true) - 1 as int)"))
    low_radius = F.lit(radius) if radius is not None else F.expr("(greatest(width, height) div shiftleft(1, _halves)) * 3 div 200")
    sized = settled(sized.withColumn("_radius", low_radius.cast("int")))
    kinds = sized.select("_halves", "_radius").distinct().collect()  # few: a row for each size that a chain has to be built for
    chains = []
    for halves, r in sorted((k["_halves"], k["_radius"]) for k in kinds):
        own = sized.filter((F.col("_halves") == halves) & (F.col("_radius") == r)).drop("_halves", "_radius")
        back = median_filter(downscale_pow2(own, halves) if halves else own, r)
        if halves:
            back = settled(upscale_pow2(back, halves).join(own.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id"))
            back = convolve(from_pixels(back, at, F.col("_w"), F.col("_h")).drop("_w", "_h"), rect_kernel(halves, halves))
        chains.append(without_background(own.join(back.select("image_id", F.col("data").alias("_back")), "image_id")))
    if not chains:
        return images
    found = chains[0]
    for more in chains[1:]:
        found = found.unionByName(more)
    return found


def without_background(both: DataFrame) -> DataFrame:
    """Images beside their background _back: f = max(back - v, 0) / 255, and f v + (1 - f) 255 is stretched over its middle 96 %."""
    lift = F.zip_with("data", "_back", lambda v, b: (F.greatest(b - v, F.lit(0)) * v + (255 - F.greatest(b - v, F.lit(0))) * 255) / 255.0)
    raised = settled(both.withColumn("data", F.transform(lift, lambda v: F.floor(F.round(v, 9)).cast("int"))).drop("_back"))
    raised = settled(raised.withColumn("_order", F.sort_array("data")))
    order = F.col("_order")
    low, high = F.get(order, F.floor(F.size(order) * 0.02).cast("int")), F.get(order, F.ceil(F.size(order) * 0.98).cast("int") - 1)
    bounds = settled(raised.withColumn("_low", low).withColumn("_high", high).drop("_order"))
    stretched = F.transform("data", lambda v: F.when(F.col("_high") > F.col("_low"), F.least(F.greatest(F.floor((v - F.col("_low")) * 255 / (F.col("_high") - F.col("_low"))), F.lit(0)), F.lit(255))).otherwise(v).cast("int"))
    return bounds.withColumn("data", stretched).drop("_low", "_high")
