"""Components, thresholds by their number, and skeletons against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.operators import aggregates as A
from quillframe.operators import neighbourhood as N

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def flooded(on):
    """Labels by flood fill, place after place."""
    h, w = len(on), len(on[0])
    labels, n = [[0] * w for _ in range(h)], 0
    for y in range(h):
        for x in range(w):
            if on[y][x] and not labels[y][x]:
                n += 1
                work, labels[y][x] = [(y, x)], n
                while work:
                    a, b = work.pop()
                    for d, e in EIGHT:
                        if 0 <= a + d < h and 0 <= b + e < w and on[a + d][b + e] and not labels[a + d][b + e]:
                            labels[a + d][b + e] = n
                            work.append((a + d, b + e))
    return labels


def sizes(labels):
    flat = [k for row in labels for k in row if k]
    return [flat.count(k) for k in range(1, max(flat, default=0) + 1)]


images = st.tuples(st.integers(1, 12), st.integers(1, 12)).flatmap(lambda s: st.lists(st.lists(st.integers(0, 4), min_size=s[1], max_size=s[1]), min_size=s[0], max_size=s[0]))


@settings(max_examples=150, deadline=None)
@given(images, st.integers(0, 4))
def test_labels_against_flood_fill(image, top):
    on = np.array(image) <= top
    assert A.component_labels(on).tolist() == flooded(on.tolist())


@settings(max_examples=100, deadline=None)
@given(images)
def test_components_of_every_threshold(image):
    got = list(zip(*(x.tolist() for x in A.grown_components(np.array(image)))))
    want = []
    for t in sorted({v for row in image for v in row}):
        found = sizes(flooded([[v <= t for v in row] for row in image]))
        want.append((t, len(found), max(found), sum(found)))
    assert got == want


def test_a_large_page_takes_seconds():
    """A spiral, which label passing would follow for thousands of rounds, and a page of a hundred thousand specks."""
    spiral = np.zeros((401, 401), bool)
    y = x = 0
    dy, dx, steps = 0, 1, 400
    while steps > 0:
        for _ in range(2 if steps < 400 else 3):
            for _ in range(steps):
                spiral[y, x] = True
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
        steps -= 2
    assert A.component_labels(spiral).max() == 1
    specks = np.zeros((700, 1400), bool)
    specks[::3, ::3] = True
    assert A.component_labels(specks).max() == specks.sum() > 100_000
    grown = A.grown_components(np.random.default_rng(1).integers(0, 256, (500, 500)))
    assert grown[1][-1] == 1 and grown[2][-1] == grown[3][-1] == 250_000


def otsu(values):
    """The highest of the best thresholds; one value alone gives 255."""
    low, high = min(values), max(values)
    if low == high:
        return 255
    best = {}
    for t in range(low, high):
        below = [v for v in values if v <= t]
        n, m = len(below), len(values) - len(below)
        # As whole numbers: no two thresholds differ by a rounding only.
        gap = sum(below) * len(values) - sum(values) * n
        best[t] = gap * gap / (n * m)
    return max(best, key=lambda t: (best[t], t))


def within_class(values):
    """The cross-check: least variance within the classes, ties to the higher."""
    found = {}
    for t in range(min(values), max(values)):
        parts = [[v for v in values if v <= t], [v for v in values if v > t]]
        found[t] = sum(sum((v - sum(p) / len(p)) ** 2 for v in p) for p in parts)
    least = min(found.values())
    return max(t for t, v in found.items() if v <= least + 1e-6)


def searched(image):
    """Thresholds one by one from Otsu's, stopping at the first with fewer components of which one is as large as Otsu's ink."""
    values = [v for row in image for v in row]
    start = otsu(values)
    at = lambda t: sizes(flooded([[v <= t for v in row] for row in image]))
    best, fewest, ink = start, len(at(start)), sum(at(start))
    for t in range(start + 1, 255):
        found = at(t)
        if len(found) < fewest:
            if max(found) >= ink:
                break
            best, fewest = t, len(found)
    return start, best, fewest


def test_threshold_with_the_fewest_components(spark):
    rng, rows = random.Random(8), []
    for k in range(12):
        w, h = rng.randint(1, 9), rng.randint(1, 9)
        page = [[min(255, max(0, int(rng.gauss(40 if rng.random() < 0.35 else 200, 45)))) for _ in range(w)] for _ in range(h)]
        rows.append((k, w, h, page))
    rows += [(50, 4, 1, [[9, 9, 9, 9]]), (51, 5, 1, [[0, 100, 0, 250, 250]]), (52, 9, 1, [[0, 90, 0, 255, 0, 90, 0, 255, 255]])]
    df = spark.createDataFrame([(k, w, h, [v for row in page for v in row]) for k, w, h, page in rows], "image_id long, width int, height int, data array<int>")
    got = {r["image_id"]: (r["otsu"], r["t"], r["components"]) for r in A.component_threshold(df).collect()}
    assert got == {k: searched(page) for k, _, _, page in rows}
    assert any(t > o for o, t, _ in got.values())
    for _, _, _, page in rows[:12]:
        values = [v for row in page for v in row]
        if len(set(values)) > 1:
            assert otsu(values) == within_class(values)


def test_empty_and_missing_images(spark):
    none = spark.createDataFrame([], "image_id long, width int, height int, data array<int>")
    assert A.connected_components(none).count() == A.component_threshold(none).count() == 0


# Skeletons


def thin_slowly(on):
    """By turns: all ink that goes in a subiteration is found before any is taken."""
    on, k, idle = {(y, x) for y, row in enumerate(on) for x, v in enumerate(row) if v}, 0, 0
    while idle < 2:
        gone = set()
        for y, x in on:
            n, ne, e, se, s, sw, w, nw = ((y + a, x + b) in on for a, b in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)))
            runs = sum([not n and (ne or e), not e and (se or s), not s and (sw or w), not w and (nw or n)])
            pairs = min(sum([nw or n, ne or e, se or s, sw or w]), sum([n or ne, e or se, s or sw, w or nw]))
            side = (n or ne or not se) and e if k == 0 else (s or sw or not nw) and w
            if runs == 1 and 2 <= pairs <= 3 and not side:
                gone.add((y, x))
        on, k, idle = on - gone, 1 - k, 0 if gone else idle + 1
    return on


@settings(max_examples=150, deadline=None)
@given(images, st.integers(0, 4))
def test_skeleton_against_loops(image, top):
    ink = np.array(image) <= top
    thin = N.thinned(ink)
    assert {tuple(p) for p in np.argwhere(thin).tolist()} == thin_slowly(ink.tolist())
    assert not (thin & ~ink).any() and A.component_labels(thin).max() == A.component_labels(ink).max()
    assert (N.thinned(thin) == thin).all()


@pytest.mark.parametrize("thick", [3, 5, 9])
def test_skeleton_of_a_bar_is_a_line(thick):
    bar = np.zeros((thick + 4, 40), bool)
    bar[2 : 2 + thick, 3:37] = True
    thin = N.thinned(bar)
    assert (thin.sum(axis=0) <= 1).all() and thin.any(axis=0).sum() >= 34 - thick


def test_skeletons_of_images(spark):
    df = spark.createDataFrame([(1, 3, 3, [0] * 9), (2, 2, 2, [255] * 4), (3, 1, 1, [0])], "image_id long, width int, height int, data array<int>")
    got = {r["image_id"]: list(r["data"]) for r in N.skeleton(df).collect()}
    assert sum(got[1]) == 255 and got[2] == [0] * 4 and got[3] == [255]
