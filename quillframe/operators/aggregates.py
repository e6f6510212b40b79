"""Aggregations over pixels: histograms and thresholds, profiles, runs, components, lines and angles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.functions.samples import threshold
from quillframe.operators.neighbourhood import PREWITT, edges
from quillframe.sources.images import pixels, settled
from quillframe.sources.tables import spread


def histogram(rows: DataFrame, value: str = "v", *by: str) -> DataFrame:
    return rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def otsu(counts: DataFrame, value: str = "v", by: str = "image_id", top: int = 255) -> DataFrame:
    """(by, t) of a histogram: the threshold with the most variance between classes, ties to the higher.

    Every whole number from the lowest value to the highest minus 1 counts, empty ones too. Variances are compared
    as exact fractions' doubles of whole sums: n1 n2 (u1 - u2)^2 = (s1 n - s n1)^2 / (n1 n2). One value alone gives top.
    """
    bins = counts.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col(value)).alias("s_all"))
    dense = bins.filter("high > low").select("*", F.explode(F.expr("sequence(low, high - 1)")).alias("t"))
    held = dense.join(counts.select(F.col(by), F.col(value).alias("t"), "n"), [by, "t"], "left")
    so_far = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = held.withColumn("n1", F.sum(F.coalesce("n", F.lit(0))).over(so_far)).withColumn("s1", F.sum(F.coalesce("n", F.lit(0)) * F.col("t")).over(so_far))
    gap = (F.col("s1") * F.col("n_all") - F.col("s_all") * F.col("n1")).cast("double")
    best = sums.groupBy(by).agg(F.max_by("t", F.struct((gap * gap / (F.col("n1") * (F.col("n_all") - F.col("n1"))).cast("double")).alias("v"), "t")).alias("t"))
    return bins.select(by).join(best, by, "left").select(by, F.coalesce("t", F.lit(top)).cast("int").alias("t"))


def otsu_images(images: DataFrame) -> DataFrame:
    """images, binarised at their own Otsu thresholds, with the threshold as t."""
    found = otsu(histogram(pixels(images), "v", "image_id"))
    both = images.join(found, "image_id")
    return both.withColumn("data", F.transform("data", lambda v: threshold(v, F.col("t"))))


def stretched(images: DataFrame, low: int = 0, high: int = 255, share_low: float = 0.0, share_high: float = 0.0) -> DataFrame:
    """images with their samples from low to high, linearly, where shares of the darkest and of the brightest samples go to these ends; truncated.

    At least one sample is at each end. Where the same value is at both, samples are moved but not stretched.
    """
    n = F.size("_order")
    count = lambda share: F.greatest(F.ceil(F.lit(share) * n), F.lit(1)).cast("int")
    ordered = settled(images.withColumn("_order", F.sort_array("data")))
    ends = settled(ordered.withColumns({"_low": F.get("_order", count(share_low) - 1), "_high": F.get("_order", n - count(share_high))}))
    scale = F.when(F.col("_high") > F.col("_low"), F.lit(float(high - low)) / (F.col("_high") - F.col("_low"))).otherwise(1.0)
    moved = F.transform("data", lambda v: F.least(F.greatest(F.round((v - F.col("_low")) * scale + low, 9), F.lit(low)), F.lit(high)).cast("int"))
    return settled(ends.withColumn("data", moved)).drop("_order", "_low", "_high")


def row_profile(images: DataFrame) -> DataFrame:
    return pixels(images).groupBy("image_id", "y").agg(F.sum("v").alias("total"), F.round(F.avg("v"), 6).alias("mean"))


def column_profile(images: DataFrame) -> DataFrame:
    return pixels(images).groupBy("image_id", "x").agg(F.sum("v").alias("total"), F.round(F.avg("v"), 6).alias("mean"))


def smoothed(profile: DataFrame, radius: int, by: str, at: str, value: str) -> DataFrame:
    """Means over 2 radius + 1 places, zeros outside."""
    around = Window.partitionBy(by).orderBy(at).rowsBetween(-radius, radius)
    return profile.select(by, at, F.round(F.sum(value).over(around) / F.lit(2.0 * radius + 1), 6).alias("smooth"))


def angled_profile(images: DataFrame, degrees: float) -> DataFrame:
    """Means along lines at an angle: place is the rounded distance of a pixel from the line through the centre."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    px = pixels(images, "height")
    away = (F.col("y") - (F.col("height") - 1) / 2) * F.lit(c) - F.col("x") * F.lit(s)
    return px.groupBy("image_id", F.floor(F.round(away, 9) + 0.5).cast("int").alias("place")).agg(F.sum("v").alias("total"), F.round(F.avg("v"), 6).alias("mean"))


def runs(rows: DataFrame, by: list[str], at: str, on: Column) -> DataFrame:
    """(by, length): lengths of unbroken runs of rows for which on holds, in the order of at."""
    w = Window.partitionBy(*by).orderBy(at)
    marked = rows.withColumn("_on", on).withColumn("_k", F.row_number().over(w)).filter("_on")
    island = marked.withColumn("_island", F.col("_k") - F.row_number().over(w))
    return island.groupBy(*by, "_island").agg(F.count(F.lit(1)).alias("length")).drop("_island")


def run_lengths(rows: DataFrame, by: list[str], at: str, on: Column) -> DataFrame:
    """(by, longest, mean) of the runs; 0 where there is none."""
    some = runs(rows, by, at, on).groupBy(*by).agg(F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean"))
    every = rows.select(*by).distinct()
    return every.join(some, by, "left").select(*by, F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def find(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Roots of nodes, which point to them from then on."""
    root = parent[nodes]
    while (up := parent[root]).tobytes() != root.tobytes():
        root = up
    parent[nodes] = root
    return root


def join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the trees of a[k] and b[k] for all k: every root takes the smallest number. Returns the roots that are none any more, and theirs."""
    gone = [np.zeros(0, np.int64)]
    while True:
        a, b = find(parent, a), find(parent, b)
        apart = a != b
        if not apart.any():
            gone = np.concatenate(gone)
            return gone, find(parent, gone)
        a, b = a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(parent, high, low)
        gone.append(np.unique(high))


def component_labels(on: np.ndarray) -> np.ndarray:
    """8-connected components, numbered from 1 in the order of their first place; 0 where off. Runs of a row are joined with those they touch in the row above."""
    h, w = on.shape
    turn = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(turn == 1)
    last = np.nonzero(turn == -1)[1] - 1
    parent, wide = np.arange(len(row)), w + 2
    # Of the row above, the first run that ends at this one's start or behind, and the last that starts at its end or before, corners included.
    low = np.searchsorted(row * wide + last, (row - 1) * wide + first - 1)
    high = np.searchsorted(row * wide + first, (row - 1) * wide + last + 1, "right")
    n = np.maximum(high - low, 0)
    touching = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    join(parent, np.repeat(np.arange(len(row)), n), touching)
    roots, number = np.unique(find(parent, np.arange(len(row))), return_inverse=True)
    labels = np.zeros(h * w + 1, np.int64)
    np.add.at(labels, row * w + first, number + 1)
    np.add.at(labels, row * w + last + 1, -number - 1)
    return np.cumsum(labels)[:-1].reshape(h, w)


def grown_components(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each value that occurs: it, the 8-connected components of samples up to it, the largest one's samples, and all of them.

    One pass: samples come in by value, and pairs of neighbours join where the later one of them does.
    """
    h, w = values.shape
    place = np.arange(h * w).reshape(h, w)
    pairs = [(place[:, :-1], place[:, 1:]), (place[:-1], place[1:]), (place[:-1, :-1], place[1:, 1:]), (place[:-1, 1:], place[1:, :-1])]
    a, b = (np.concatenate([p[k].ravel() for p in pairs]) for k in (0, 1))
    flat = values.ravel()
    later = np.maximum(flat[a], flat[b])
    order = np.argsort(later, kind="stable")
    a, b = a[order], b[order]
    levels, fresh = np.unique(flat, return_counts=True)
    ends = np.searchsorted(later[order], levels, "right")
    parent, size, found, n, largest = np.arange(h * w), np.ones(h * w, np.int64), [], 0, 1
    for new, start, end in zip(fresh.tolist(), [0, *ends.tolist()], ends.tolist()):
        gone, root = join(parent, a[start:end], b[start:end])
        np.add.at(size, root, size[gone])
        n, largest = n + new - len(gone), max(largest, int(size[root].max(initial=1)))
        found.append((n, largest))
    return levels, *np.array(found, np.int64).reshape(-1, 2).T, np.cumsum(fresh)


def connected_components(images: DataFrame, background: int = 255) -> DataFrame:
    """(image_id, y, x, label): 8-connected components, numbered from 1 in the order of their first pixel; background 0.

    An image's runs are joined in its own row, in time linear in its samples; nothing is shuffled.
    """

    @F.pandas_udf("array<int>")
    def labels(width: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else component_labels(np.asarray(d).reshape(-1, int(w)) != background).ravel().astype(np.int32) for w, d in zip(width, data)], dtype=object)

    return pixels(spread(images.select("image_id", "width", "data"), "image_id").withColumn("data", labels("width", "data"))).withColumnRenamed("v", "label")


def component_levels(images: DataFrame) -> DataFrame:
    """(image_id, levels): for each value t of an image, how many components the samples up to t make, the largest one's samples, and all of them as ink."""

    @F.pandas_udf("t array<int>, components array<int>, largest array<int>, ink array<int>")
    def grown(width: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = [[x.astype(np.int32) for x in grown_components(np.asarray(d).reshape(-1, int(w)))] for w, d in zip(width, data)]
        return pd.DataFrame(rows, columns=["t", "components", "largest", "ink"], dtype=object)

    whole = spread(images.filter("size(data) > 0").select("image_id", "width", "data"), "image_id")
    made = settled(whole.select("image_id", grown("width", "data").alias("g")))
    return made.select("image_id", F.arrays_zip("g.t", "g.components", "g.largest", "g.ink").alias("levels"))


def component_threshold(images: DataFrame) -> DataFrame:
    """(image_id, otsu, t, components): the threshold from Otsu's to 254 with the fewest components; the lowest of several.

    It stops where a component is as large as all ink at Otsu's threshold. As components only grow with the
    threshold, these are the thresholds whose largest component is smaller. Between an image's values nothing changes.
    """
    both = settled(component_levels(images).join(otsu(histogram(pixels(images), "v", "image_id")).withColumnRenamed("t", "otsu"), "image_id"))
    start = settled(both.withColumn("at_otsu", F.element_at(F.filter("levels", lambda v: v["t"] <= F.col("otsu")), -1)))
    later = F.filter("levels", lambda v: (v["t"] > F.col("otsu")) & (v["t"] < 255) & (v["largest"] < F.col("at_otsu.ink")) & (v["components"] < F.col("at_otsu.components")))
    fewest = settled(start.withColumn("best", F.array_min(F.transform(later, lambda v: F.struct(v["components"].alias("n"), v["t"].alias("t"))))))
    return fewest.select("image_id", "otsu", F.coalesce("best.t", "otsu").alias("t"), F.coalesce("best.n", "at_otsu.components").alias("components"))


def component_stats(labels: DataFrame) -> DataFrame:
    """Box, size, first pixel and truncated centroid of each component."""
    first = F.min(F.struct("y", "x"))
    found = labels.filter("label > 0").groupBy("image_id", "label").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"), first.alias("f"), F.sum("x").alias("sx"), F.sum("y").alias("sy")
    )
    return found.select("image_id", "label", "x0", "y0", "x1", "y1", "n", F.col("f.x").alias("first_x"), F.col("f.y").alias("first_y"), F.expr("sx div n").cast("int").alias("cx"), F.expr("sy div n").cast("int").alias("cy"))


def nearest_component(labels: DataFrame) -> DataFrame:
    """(image_id, y, x, distance, nearest): L1 distance of each pixel to the nearest component; ties to the lower label, nulls without any.

    The distance parts into a column's and a row's, so running minima down, up, right and left find it: four sorts of an
    image's pixels and one shuffle, however many of them are labelled.
    """
    first = F.when(F.col("label") > 0, F.struct(F.lit(0).alias("d"), F.col("label").alias("l")))
    rows = labels.repartition("image_id").withColumn("near", first)
    moved = lambda s, by: F.when(s.isNotNull(), F.struct((s["d"] + by).alias("d"), s["l"].alias("l")))
    for line, along in (("x", "y"), ("y", "x")):
        at = F.col(along)
        ahead = Window.partitionBy("image_id", line).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        behind = Window.partitionBy("image_id", line).orderBy(at.desc()).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("a", F.min(moved(F.col("near"), -at)).over(ahead)).withColumn("b", F.min(moved(F.col("near"), at)).over(behind))
        rows = rows.withColumn("near", F.least(moved(F.col("a"), at), moved(F.col("b"), -at)))
    return rows.select("image_id", "y", "x", F.col("near.d").alias("distance"), F.col("near.l").alias("nearest"))


def hough_votes(images: DataFrame, degrees: list[int], least: int = 128, part: str = "magnitude", r_step: float = 1.0) -> DataFrame:
    """(image_id, theta, r, votes): edge pixels of at least the given strength vote for r = y cos + x sin of each angle."""
    strong = pixels(edges(images, part=part)).filter(F.col("v") >= least)
    angles = F.explode(F.array(*[F.struct(F.lit(d).alias("theta"), F.lit(math.cos(math.radians(d))).alias("c"), F.lit(math.sin(math.radians(d))).alias("s")) for d in degrees]))
    votes = strong.select("image_id", "y", "x", angles.alias("a"))
    r = F.floor(F.round((F.col("y") * F.col("a.c") + F.col("x") * F.col("a.s")) / F.lit(r_step), 9) + 0.5).cast("int")
    return votes.groupBy("image_id", F.col("a.theta").alias("theta"), r.alias("r")).agg(F.count(F.lit(1)).alias("votes"))


def slant_histogram(images: DataFrame, degrees: list[int], ink: int = 0, least: int = 1) -> DataFrame:
    """(image_id, angle, score): over lines slanted by angle, the sum of squares of their longest ink runs above least."""
    angles = F.explode(F.array(*[F.struct(F.lit(d).alias("angle"), F.lit(math.tan(math.radians(d))).alias("t")) for d in degrees]))
    px = pixels(images, "height").withColumn("a", angles)
    line = F.floor(F.round(F.col("x") - (F.col("height") - 1 - F.col("y")) * F.col("a.t"), 9) + 0.5).cast("int")
    placed = px.select("image_id", F.col("a.angle").alias("angle"), line.alias("line"), "y", "x", "v").groupBy("image_id", "angle", "line", "y").agg(F.min(F.when(F.col("v") == ink, 0).otherwise(1)).alias("off"))
    longest = runs(placed, ["image_id", "angle", "line"], "y", F.col("off") == 0).groupBy("image_id", "angle", "line").agg(F.max("length").alias("run")).filter(F.col("run") > least)
    scored = longest.groupBy("image_id", "angle").agg(F.sum(F.col("run") * F.col("run")).alias("score"))
    every = images.select("image_id", F.explode(F.array(*map(F.lit, degrees))).alias("angle"))
    return every.join(scored, ["image_id", "angle"], "left").select("image_id", "angle", F.coalesce("score", F.lit(0)).alias("score"))


def slant_angle(images: DataFrame, degrees: list[int], radius: int = 1) -> DataFrame:
    """The angle with the largest smoothed score; the least such angle, and 0 where nothing scores."""
    smooth = smoothed(slant_histogram(images, degrees), radius, "image_id", "angle", "score")
    best = smooth.groupBy("image_id").agg(F.max_by("angle", F.struct("smooth", (-F.col("angle")).alias("k"))).alias("angle"), F.max("smooth").alias("smooth"))
    return best.select("image_id", F.when(F.col("smooth") > 0, F.col("angle")).otherwise(0).alias("angle"))


def skew_variance(images: DataFrame, degrees: list[int] | Column) -> DataFrame:
    """(image_id, angle, variance): population variance of the profile along each angle; degrees may be an array column, so that images have angles of their own."""
    if isinstance(degrees, list):
        angles = F.array(*[F.struct(F.lit(d).alias("angle"), F.lit(math.cos(math.radians(d))).alias("c"), F.lit(math.sin(math.radians(d))).alias("s")) for d in degrees])
    else:
        angles = F.transform("_degrees", lambda d: F.struct(d.alias("angle"), F.cos(F.radians(d)).alias("c"), F.sin(F.radians(d)).alias("s")))
        images = images.withColumn("_degrees", degrees)
    px = pixels(images, "height", *([] if isinstance(degrees, list) else ["_degrees"])).withColumn("a", F.explode(angles))
    away = (F.col("y") - (F.col("height") - 1) / 2) * F.col("a.c") - F.col("x") * F.col("a.s")
    bins = px.groupBy("image_id", F.col("a.angle").alias("angle"), F.floor(F.round(away, 9) + 0.5).cast("int").alias("place")).agg(F.avg("v").alias("mean"))
    # From the means in order: equal variances come out equal, whatever the order of rows.
    means = bins.groupBy("image_id", "angle").agg(F.sort_array(F.collect_list("mean")).alias("m"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    centred = settled(means.withColumn("mid", total(F.col("m")) / F.size("m")))
    return centred.select("image_id", "angle", F.round(total(F.transform("m", lambda v: (v - F.col("mid")) * (v - F.col("mid")))) / F.size("m"), 9).alias("variance"))


def skew_angle(images: DataFrame, degrees: list[int]) -> DataFrame:
    spread = skew_variance(images, degrees)
    return spread.groupBy("image_id").agg(F.max_by("angle", F.struct("variance", (-F.col("angle")).alias("k"))).alias("angle"))


def skew_angle_fast(images: DataFrame, coarse: int = 5, most: int = 15) -> DataFrame:
    """A coarse search over edges, then single degrees around each image's coarse angle."""
    lines = edges(images, PREWITT, "dy")
    rough = skew_angle(lines, list(range(-most, most + 1, coarse))).withColumnRenamed("angle", "rough")
    fine = skew_variance(lines.join(rough, "image_id"), F.sequence(F.col("rough") - (coarse - 1), F.col("rough") + (coarse - 1)))
    return fine.groupBy("image_id").agg(F.max_by("angle", F.struct("variance", (-F.col("angle")).alias("k"))).alias("angle"))


def vector_sum(vectors: DataFrame, column: str, *by: str) -> DataFrame:
    """Element-wise sums and means of arrays."""
    parts = vectors.select(*by, F.posexplode(column).alias("dim", "e")).groupBy(*by, "dim").agg(F.sum("e").alias("total"), F.avg("e").alias("mean"))
    return parts.select(*by, "dim", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))
