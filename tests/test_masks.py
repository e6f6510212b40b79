"""Masks of real radii against plain loops, and small and large forms against each other."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.operators import masks
from quillframe.operators import neighbourhood as N

rng = np.random.default_rng(4)


def under(image, offsets):
    h, w = image.shape
    return np.stack([image[np.clip(np.arange(h) + dy, 0, h - 1)][:, np.clip(np.arange(w) + dx, 0, w - 1)] for dy, dx in offsets])


@pytest.mark.parametrize("shape", [N.square, N.circle])
@pytest.mark.parametrize(("size", "radius"), [((9, 13), 3), ((40, 31), 15), ((1, 7), 4), ((5, 1), 9)])
def test_masks_against_all_samples_under_them(shape, size, radius, monkeypatch):
    monkeypatch.setattr(masks, "HELD", 900)
    image, offsets = rng.integers(0, 256, size), shape(radius)
    rows = masks.reaches(offsets)
    seen = np.sort(under(image, offsets), axis=0)
    assert (masks.sliding_rank(image, rows, len(offsets) // 2) == seen[len(offsets) // 2]).all()
    assert (masks.extreme(image, rows, np.maximum) == seen[-1]).all() and (masks.extreme(image, rows, np.minimum) == seen[0]).all()
    assert masks.reaches([(0, 0), (0, 2)]) is None


@pytest.mark.parametrize("kernel", [N.gauss_kernel(7), N.rect_kernel(4, 2), N.circle_kernel(5), N.log_kernel(6), N.laplace_kernel(), [(0, 0, 0.0)] * 30])
def test_kernels_in_two_passes_or_one(kernel):
    image = rng.integers(0, 256, (22, 17))
    want = np.tensordot([w for _, _, w in kernel], under(image, [(dy, dx) for dy, dx, _ in kernel]), 1)
    assert np.allclose(masks.weighed(image, kernel), want, atol=1e-9)


def test_sums_and_means():
    image = rng.integers(0, 256, (11, 6))
    for radius in (0, 1, 4):
        assert (masks.box_sums(image, radius) == under(image, N.square(radius)).sum(axis=0)).all()
    means = masks.block_means(image, 4)
    assert means.tolist() == [[int(image[y : y + 4, x : x + 4].sum()) // image[y : y + 4, x : x + 4].size for x in (0, 4)] for y in (0, 4, 8)]


def test_a_page_with_a_wide_mask_takes_seconds():
    page, began = rng.integers(0, 256, (600, 800)), time.perf_counter()
    masks.sliding_rank(page, masks.reaches(N.square(15)), 480)
    masks.extreme(page, masks.reaches(N.circle(15)), np.maximum)
    masks.weighed(page, N.gauss_kernel(15))
    assert time.perf_counter() - began < 30


def frame(spark, images):
    rows = [(k, i.shape[1], i.shape[0], i.ravel().tolist()) for k, i in enumerate(images)]
    return spark.createDataFrame(rows, "image_id long, width int, height int, data array<int>")


def test_both_forms_give_the_same(spark, monkeypatch):
    images = [rng.integers(0, 256, (7, 9)), rng.integers(0, 4, (3, 3))]
    made = [
        lambda d: N.median_filter(d, 2), lambda d: N.median_filter(d, 2, N.circle), lambda d: N.max_filter(d, 2, N.circle), lambda d: N.min_filter(d, 1),
        lambda d: N.convolve(d, N.gauss_kernel(2)), lambda d: N.convolve(d, N.laplace_kernel()), lambda d: N.convolve(d, N.log_kernel(2), integer=False),
    ]
    results = []
    for small in (100, 0):
        monkeypatch.setattr(N, "SMALL", small)
        results.append([[list(r["data"]) for r in f(frame(spark, images)).orderBy("image_id").collect()] for f in made])
    for a, b in zip(*results):
        assert all(np.allclose(x, y, atol=1e-8) for x, y in zip(a, b))


def background(image, radius):
    back = np.sort(under(image, N.square(radius)), axis=0)[(2 * radius + 1) ** 2 // 2]
    return lifted(image, back)


def lifted(image, back):
    f = np.maximum(back - image, 0)
    raised = np.floor(np.round((f * image + (255 - f) * 255) / 255, 9)).astype(int)
    order = np.sort(raised.ravel())
    low, high = order[int(np.floor(len(order) * 0.02))], order[int(np.ceil(len(order) * 0.98)) - 1]
    return np.clip(np.floor((raised - low) * 255 / (high - low)), 0, 255).astype(int) if high > low else raised


def test_low_resolution_background_of_several_sizes(spark):
    images = [rng.integers(0, 256, s) for s in ((6, 6), (30, 21), (9, 40), (64, 33))]
    found = {r["image_id"]: list(r["data"]) for r in N.remove_low_res_background(frame(spark, images), 1, (3, 3), (16, 16)).collect()}
    for k, image in enumerate(images):
        h, w, n = *image.shape, 0
        while w > 3 and h > 3 and (w > 16 or h > 16):
            w, h, n = w // 2, h // 2, n + 1
        if not n:
            want = background(image, 1)
        else:
            low = masks.block_means(image, 2**n)
            low = np.sort(under(low, N.square(1)), axis=0)[4]
            grown = np.kron(low, np.ones((2**n, 2**n), int))[: image.shape[0], : image.shape[1]]
            smooth = np.floor(np.round(under(grown, N.square(n)).mean(axis=0), 9)).astype(int)
            want = lifted(image, smooth)
        assert found[k] == want.ravel().tolist(), k
    assert N.remove_low_res_background(frame(spark, images).limit(0)).count() == 0


def test_box_has_the_frames_of_the_image(spark):
    image = rng.integers(0, 256, (5, 4))
    got = {(r["y"], r["x"]): (r["v"], r["s"], r["s2"]) for r in N.box(frame(spark, [image]), 3).collect()}
    near = under(image, N.square(3))
    assert got == {(y, x): (image[y, x], near[:, y, x].sum(), (near[:, y, x] ** 2).sum()) for y in range(5) for x in range(4)}
    assert N.box(frame(spark, [image]).filter(F.lit(False)), 1).count() == 0


@pytest.mark.parametrize("held", [1, 2000, 1 << 22])
def test_bilateral_grid_against_loops(held, monkeypatch):
    monkeypatch.setattr(masks, "HELD", held)
    image, blur = rng.integers(0, 256, (13, 9)), {-2: 1 / 16, -1: 1 / 4, 0: 3 / 8, 1: 1 / 4, 2: 1 / 16}
    grid, (h, w) = {}, image.shape
    for y, x in np.ndindex(h, w):
        home = [int(np.floor(k + 0.5)) for k in (y / 3.0, x / 3.0, image[y, x] / 40.0)]
        for (i, p), (j, q), (k, r) in itertools.product(blur.items(), repeat=3):
            at = grid.setdefault((home[0] + i, home[1] + j, home[2] + k), [0.0, 0.0])
            at[0] += p * q * r
            at[1] += p * q * r * image[y, x]
    got, other, dark = masks.bilateral(np.stack([image, image[::-1], image // 9]), 3.0, 40.0)
    assert (masks.bilateral(image[None, ::-1], 3.0, 40.0)[0] == other).all() and (masks.bilateral(image[None] // 9, 3.0, 40.0)[0] == dark).all()
    for y, x in np.ndindex(h, w):
        place, sums = np.array([y / 3.0, x / 3.0, image[y, x] / 40.0]), np.zeros(2)
        for corner in np.ndindex(2, 2, 2):
            part = place - np.floor(place)
            sums += np.prod(np.where(corner, part, 1 - part)) * np.array(grid.get(tuple(int(k) for k in np.floor(place) + corner), [0.0, 0.0]))
        assert got[y, x] == np.floor(round(sums[1] / sums[0], 6))


def test_bilateral_moves_no_sample(spark):
    df = spark.createDataFrame([(1, 2, 2, [1, 2, 3, 250])], "image_id long, width int, height int, data array<int>")
    assert "Exchange" not in N.bilateral(df, 2.0, 32.0)._jdf.queryExecution().executedPlan().toString()
