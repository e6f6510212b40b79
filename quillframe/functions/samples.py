"""Functions of one sample, or of samples that stand together. All are plain column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold(v: Column, t: Column | int) -> Column:
    """Ink (0) up to t, background (255) above."""
    return F.when(v <= t, 0).otherwise(255)


def range_map(v: Column, t1: int, t2: int, low: int, mid: int, high: int) -> Column:
    """low below t1, high above t2, mid between; -1 leaves the sample as it is."""
    give = lambda k: v if k == -1 else F.lit(k)
    return F.when(v < t1, give(low)).when(v > t2, give(high)).otherwise(give(mid))


def saturated(v: Column, top: int = 255) -> Column:
    """Truncated and kept in the range of an unsigned sample."""
    return F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(top))


def clamp(v: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def invert(v: Column, top: int = 255) -> Column:
    return F.lit(top) - v


def log_scale(v: Column, base: float) -> Column:
    return F.log(v.cast("double")) / F.log(F.lit(float(base)))


def rescale(v: Column, old_low: Column, old_high: Column, low: int, high: int) -> Column:
    """Linear from the old range to the new one; an image of one value goes to low."""
    span = F.when(old_high > old_low, (v - old_low) * (high - low) / (old_high - old_low)).otherwise(0.0)
    return (F.lit(low) + span).cast("int")


def as_unsigned(v: Column, bits: int) -> Column:
    """Truncated to a whole number of so many bits; higher bits are lost, nothing is rescaled."""
    return F.pmod(v.cast("long"), F.lit(1 << bits))


#: Shares of R, G and B in a grey sample. Fixed values.
GRAY = (0.299, 0.587, 0.114)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luminance, truncated."""
    return F.floor(F.round(r * GRAY[0] + g * GRAY[1] + b * GRAY[2], 9)).cast("int")


def line_ends(w: Column, h: Column, r: Column, degrees: Column) -> Column:
    """(x0, y0, x1, y1) where the line r = y cos + x sin meets the border of a w x h image; all -1 where it misses it.

    The first end is the left border's if the line meets it, else the upper or lower one's; the second is the first that is
    met of the right, upper and lower border (of lower and right, or upper and right, if the first end isn't on the left).
    A line down from the upper left corner ends on the lower border.
    Lines along an axis run from border to border, also outside the image.
    """
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    right, low = (w - 1).cast("double"), (h - 1).cast("double")
    y_at, x_at = (lambda x: F.round((r - x * s) / c, 9)), (lambda y: F.round((r - y * c) / s, 9))
    ends = lambda *four: F.struct(*[e.cast("double").alias(n) for e, n in zip(four, ("x0", "y0", "x1", "y1"))])
    none, zero = F.lit(-1.0), F.lit(0.0)
    on_left, on_right = y_at(zero).between(zero, low), y_at(right).between(zero, low)
    on_top, on_low = x_at(zero).between(zero, right), x_at(low).between(zero, right)
    top, bottom, side = (x_at(zero), zero), (x_at(low), low), (right, y_at(right))
    left = (zero, y_at(zero))
    above = y_at(zero) < 0
    return (
        F.when(F.abs(s) < 1e-5, ends(zero, r / c, right, r / c)).when(F.abs(c) < 1e-5, ends(r / s, zero, r / s, low))
        .when(on_left & on_right, ends(*left, *side)).when(on_left & on_top & ~((y_at(zero) == 0) & on_low), ends(*left, *top)).when(on_left, ends(*left, *bottom))
        .when(above & on_top & on_low, ends(*top, *bottom)).when(above & on_top, ends(*top, *side))
        .when(~above & on_low & on_top, ends(*bottom, *top)).when(~above & on_low, ends(*bottom, *side))
        .otherwise(ends(none, none, none, none))
    )


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in [0, 1]; hue is 0 where saturation is."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    turn = F.when(r == top, (g - b) / span).when(g == top, 2 + (b - r) / span).otherwise(4 + (r - g) / span) * 60
    hue = F.when(span == 0, 0.0).when(turn < 0, turn + 360).otherwise(turn)
    return hue, F.when(top == 0, 0.0).otherwise(span / top), top / 255.0


def rgb_of_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    sector = F.floor(h / 60) % 6
    part = h / 60 - F.floor(h / 60)
    p, q, t = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))
    pick = lambda *six: F.round(F.element_at(F.array(*six), (sector + 1).cast("int")) * 255).cast("int")
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


#: X, Y and Z of R, G and B, and the white that scales all three. Fixed values.
XYZ_OF_RGB = ((2.769, 1.7518, 1.13), (1.0, 4.5907, 0.0601), (0.0, 0.0565, 5.5943))
LAB_WHITE = 1440.954


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* by cube roots alone, with one white for the three coordinates."""
    x, y, z = (F.cbrt((r * m[0] + g * m[1] + b * m[2]) / LAB_WHITE) for m in XYZ_OF_RGB)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def rgb_of_lab(l: Column, a: Column, b: Column) -> tuple[Column, ...]:
    """Rounded, and kept in 0 to 255."""
    y = (l + 16) / 116
    xyz = [F.pow(c, F.lit(3.0)) * LAB_WHITE for c in (y + a / 500, y, y - b / 200)]
    return tuple(saturated(F.round(sum((c * float(k) for c, k in zip(xyz[1:], row[1:])), xyz[0] * float(row[0])))) for row in np.linalg.inv(XYZ_OF_RGB))


def point_line_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """To the infinite line; to the point where both ends are one."""
    length = F.hypot(x2 - x1, y2 - y1)
    return F.when(length == 0, F.hypot(px - x1, py - y1)).otherwise(F.abs((x2 - x1) * (y1 - py) - (x1 - px) * (y2 - y1)) / length)


def point_segment_distance(p: tuple[Column, ...], a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """In as many dimensions as the points have; the foot is kept between the ends."""
    square = lambda xs: sum((x * x for x in xs[1:]), xs[0] * xs[0])
    along = [y - x for x, y in zip(a, b)]
    dot = sum(((q - x) * d for q, x, d in list(zip(p, a, along))[1:]), (p[0] - a[0]) * along[0])
    length = square(along)
    u = F.when(length == 0, 0.0).otherwise(F.least(F.greatest(dot / length, F.lit(0.0)), F.lit(1.0)))
    return F.sqrt(square([q - (x + u * d) for q, x, d in zip(p, a, along)]))


def side_of_line(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Signed cross product: 0 on the line."""
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)


def in_polygon(px: Column, py: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges."""
    crossings = [
        ((F.lit(float(y1)) > py) != (F.lit(float(y2)) > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
        for (x1, y1), (x2, y2) in zip(corners, corners[-1:] + corners[:-1]) if y1 != y2
    ]
    count = sum((c.cast("int") for c in crossings[1:]), crossings[0].cast("int"))
    return count % 2 == 1


def barycentric(px: Column, py: Column, a: tuple, b: tuple, c: tuple) -> tuple[Column, Column, Column]:
    area = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    one = ((b[1] - c[1]) * (px - c[0]) + (c[0] - b[0]) * (py - c[1])) / area
    two = ((c[1] - a[1]) * (px - c[0]) + (a[0] - c[0]) * (py - c[1])) / area
    return one, two, 1 - one - two


def rects_meet(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Half-open rectangles overlap, crosses included."""
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def from_barycentric(one: Column, two: Column, three: Column, a: tuple, b: tuple, c: tuple) -> tuple[Column, Column]:
    """The point that has these coordinates in a triangle."""
    return tuple(one * F.lit(float(a[k])) + two * F.lit(float(b[k])) + three * F.lit(float(c[k])) for k in (0, 1))


def rect_holds(x: Column, y: Column, rx: Column, ry: Column, rw: Column, rh: Column) -> Column:
    """Whether a point is in a half-open rectangle."""
    return (x >= rx) & (x < rx + rw) & (y >= ry) & (y < ry + rh)
