"""Geometry: images to images, each sample looked up where it comes from. Nothing is shuffled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators import masks
from quillframe.sources.images import at, clamped, from_pixels, inside, settled


def _w() -> Column:
    return F.col("width")


def _h() -> Column:
    return F.col("height")


def crop(images: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """The part of the rectangle that is inside the image."""
    width = F.greatest(F.least(_w() - x0, F.lit(w)), F.lit(1))
    height = F.greatest(F.least(_h() - y0, F.lit(h)), F.lit(1))
    return from_pixels(images, lambda y, x: at(y + y0, x + x0), width, height)


def resize_canvas(images: DataFrame, w: int, h: int, fill: int = 255) -> DataFrame:
    return from_pixels(images, lambda y, x: F.when(inside(y, x), at(y, x)).otherwise(fill), F.lit(w), F.lit(h))


def pad(images: DataFrame, left: int, right: int, top: int, bottom: int, method: str = "replicate", fill: int = 255) -> DataFrame:
    """method: value, replicate, wrap or mirror."""

    def one(y: Column, x: Column) -> Column:
        y, x = y - top, x - left
        if method == "replicate":
            return clamped(y, x)
        if method == "wrap":
            return at(F.pmod(y, _h()), F.pmod(x, _w()))
        if method == "mirror":
            fold = lambda k, n: F.least(F.pmod(k, 2 * n), 2 * n - 1 - F.pmod(k, 2 * n))
            return at(fold(y, _h()), fold(x, _w()))
        return F.when(inside(y, x), at(y, x)).otherwise(fill)

    return from_pixels(images, one, _w() + left + right, _h() + top + bottom)


def paste(images: DataFrame, others: DataFrame, x0: int, y0: int) -> DataFrame:
    """The image of others with the same id overwrites samples from (x0, y0) on."""
    over = others.select("image_id", F.col("width").alias("_w2"), F.col("height").alias("_h2"), F.col("data").alias("_d2"))
    both = images.join(over, "image_id", "left")
    value = lambda y, x: F.when((y >= y0) & (x >= x0) & (y < y0 + F.col("_h2")) & (x < x0 + F.col("_w2")), F.get("_d2", (y - y0) * F.col("_w2") + x - x0)).otherwise(at(y, x))
    return from_pixels(both, value).drop("_w2", "_h2", "_d2")


def clip_to_ink(images: DataFrame, margin: int = 1) -> DataFrame:
    """The box of all ink (0) with a white margin; an image without ink stays as it is."""
    ink = F.filter(F.sequence(F.lit(0), _w() * _h() - 1), lambda i: F.get("data", i) == 0)
    xs, ys = F.transform("_ink", lambda i: i % F.col("width")), F.transform("_ink", lambda i: F.floor(i / F.col("width")).cast("int"))
    boxed = settled(images.withColumn("_ink", ink)).withColumns({"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})
    has = F.size("_ink") > 0
    w = F.when(has, F.col("_x1") - F.col("_x0") + 1 + 2 * margin).otherwise(_w())
    h = F.when(has, F.col("_y1") - F.col("_y0") + 1 + 2 * margin).otherwise(_h())
    left, top = F.when(has, F.col("_x0") - margin).otherwise(0), F.when(has, F.col("_y0") - margin).otherwise(0)
    return from_pixels(settled(boxed), lambda y, x: F.when(inside(y + top, x + left), at(y + top, x + left)).otherwise(255), w, h).drop("_ink", "_x0", "_x1", "_y0", "_y1")


def fill(images: DataFrame, value: int) -> DataFrame:
    return images.withColumn("data", F.transform("data", lambda _: F.lit(value)))


def set_pixel(images: DataFrame, x: int, y: int, value: int) -> DataFrame:
    """One sample written; a place outside the image changes nothing."""
    place = F.lit(y) * _w() + x
    written = F.transform("data", lambda v, i: F.when(i == place, value).otherwise(v))
    return images.withColumn("data", F.when(inside(F.lit(y), F.lit(x)), written).otherwise(F.col("data")))


def rotate90(images: DataFrame, turns: int = 1) -> DataFrame:
    """Clockwise quarter turns."""
    turns %= 4
    if turns == 0:
        return images
    if turns == 2:
        return from_pixels(images, lambda y, x: at(_h() - 1 - y, _w() - 1 - x))
    value = (lambda y, x: at(_h() - 1 - x, y)) if turns == 1 else (lambda y, x: at(x, _w() - 1 - y))
    return from_pixels(images, value, _h(), _w())


def bilinear(y: Column, x: Column, fill: int = 255) -> Column:
    """The sample between four others; fill counts outside."""
    y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
    get = lambda yy, xx: F.when(inside(yy, xx), at(yy, xx)).otherwise(fill)
    fy, fx = y - F.floor(y), x - F.floor(x)
    top = get(y0, x0) * (1 - fx) + F.when(fx > 0, get(y0, x0 + 1)).otherwise(0) * fx
    low = F.when(fy > 0, get(y0 + 1, x0) * (1 - fx) + F.when(fx > 0, get(y0 + 1, x0 + 1)).otherwise(0) * fx).otherwise(0)
    return F.floor(top * (1 - fy) + low * fy + 0.5).cast("int")


def scale(images: DataFrame, w: int, h: int, smooth: bool = True) -> DataFrame:
    """To w x h: each new centre is looked up in the old grid, between samples or at the nearest one."""
    old_y, old_x = (lambda y: (y + 0.5) * _h() / h - 0.5), (lambda x: (x + 0.5) * _w() / w - 0.5)
    keep = lambda k, n: F.least(F.greatest(k, F.lit(0.0)), (n - 1).cast("double"))
    if smooth:
        return from_pixels(images, lambda y, x: bilinear(keep(old_y(y), _h()), keep(old_x(x), _w())), F.lit(w), F.lit(h))
    return from_pixels(images, lambda y, x: clamped(F.floor((y + 0.5) * _h() / h).cast("int"), F.floor((x + 0.5) * _w() / w).cast("int")), F.lit(w), F.lit(h))


def downscale_pow2(images: DataFrame, n: int) -> DataFrame:
    """Means of 2^n x 2^n blocks, truncated; blocks at the right and lower edge may be smaller."""
    k = 1 << n
    if n > 2:
        means = masks.by_image(lambda image: masks.block_means(image, k))
        return settled(images.withColumn("data", means)).withColumns({"width": F.ceil(_w() / k).cast("int"), "height": F.ceil(_h() / k).cast("int")})

    def block(y: Column, x: Column) -> Column:
        cells = [F.when(inside(y * k + dy, x * k + dx), at(y * k + dy, x * k + dx)) for dy in range(k) for dx in range(k)]
        held = F.array_compact(F.array(*cells))
        return F.floor(F.aggregate(held, F.lit(0), lambda s, v: s + v) / F.size(held)).cast("int")

    return from_pixels(images, block, F.ceil(_w() / k).cast("int"), F.ceil(_h() / k).cast("int"))


def upscale_pow2(images: DataFrame, n: int) -> DataFrame:
    k = 1 << n
    return from_pixels(images, lambda y, x: at(F.floor(y / k).cast("int"), F.floor(x / k).cast("int")), _w() * k, _h() * k)


def translate(images: DataFrame, dx: float, dy: float, fill: int = 255) -> DataFrame:
    return from_pixels(images, lambda y, x: bilinear(y - F.lit(float(dy)), x - F.lit(float(dx)), fill))


def rotate(images: DataFrame, degrees: float, fill: int = 255) -> DataFrame:
    """Clockwise about the centre, on a canvas that holds the whole turned image."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    w = F.ceil(F.round(_w() * abs(c) + _h() * abs(s), 6)).cast("int")
    h = F.ceil(F.round(_w() * abs(s) + _h() * abs(c), 6)).cast("int")

    def value(y: Column, x: Column) -> Column:
        ny, nx = y - (h - 1) / 2, x - (w - 1) / 2
        back = lambda k: F.round(k, 9)
        return bilinear(back(-nx * s + ny * c + (_h() - 1) / 2), back(nx * c + ny * s + (_w() - 1) / 2), fill)

    return from_pixels(images, value, w, h)


def shear_h(images: DataFrame, degrees: float, fill: int = 255) -> DataFrame:
    """Rows shifted by their height above the lowest one times the tangent; samples between two are mixed."""
    t = math.tan(math.radians(degrees))
    extra = F.ceil(F.round(F.abs((_h() - 1) * F.lit(t)), 9)).cast("int")

    def value(y: Column, x: Column) -> Column:
        shift = (_h() - 1 - y) * F.lit(t) if t >= 0 else -y * F.lit(t)
        return bilinear(y.cast("double"), F.round(x - shift, 9), fill)

    return from_pixels(images, value, _w() + extra)


def shear_v(images: DataFrame, degrees: float, fill: int = 255) -> DataFrame:
    """The same of columns."""
    return rotate90(shear_h(rotate90(images, 1), degrees, fill), 3)
