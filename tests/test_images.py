"""The image engine: files, operators on hand-made images, and clustering against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import samples
from quillframe.operators import aggregates as A
from quillframe.operators import clustering as C
from quillframe.operators import features as V
from quillframe.operators import geometry as G
from quillframe.operators import matching as M
from quillframe.operators import neighbourhood as N
from quillframe.operators import morph
from quillframe.sources import pictures, pnm
from quillframe.sources.images import pixels


@pytest.fixture
def image(spark):
    def make(rows, image_id=1):
        return spark.createDataFrame([(image_id, len(rows[0]), len(rows), [v for r in rows for v in r])], "image_id long, width int, height int, data array<int>")

    return make


def data(df):
    return df.first()["data"]


def test_distance_map_of_rows(image):
    assert data(N.distance_map(image([[255, 255, 0, 255, 255]]))) == [2, 1, 0, 1, 2]
    assert data(N.distance_map(image([[255, 0, 0, 0, 0, 0, 255]]))) == [1, 0, -1, -2, -1, 0, 1]
    assert data(N.distance_map(image([[255, 255]]))) == [240, 240] and data(N.distance_map(image([[0, 0]]))) == [-12, -12]


@pytest.mark.parametrize(("bins", "t"), [({10: 5, 20: 5}, 19), ({7: 9}, 255), ({0: 1, 1: 1}, 0)])
def test_otsu(spark, bins, t):
    rows = spark.createDataFrame([(1, v, n) for v, n in bins.items()], "image_id long, v int, n long")
    assert A.otsu(rows).first()["t"] == t


def test_runs_of_a_column(image):
    px = pixels(image([[0], [0], [255], [0]]))
    r = A.run_lengths(px, ["image_id", "x"], "y", F.col("v") == 0).first()
    assert (r["longest"], r["mean"]) == (2, 1.5)


def test_transitions_and_gaps(image):
    f = V.column_features(image([[0, 255, 255, 255], [255, 255, 255, 255], [0, 255, 255, 0], [0, 255, 255, 255]])).orderBy("x").collect()
    assert f[0]["trans"] == pytest.approx(2 / 6) and [r["lower"] for r in f] == [pytest.approx(k) for k in (0.5, 0.5, 0.5, 1)]


def test_components(image):
    found = A.connected_components(image([[0, 255, 255], [255, 0, 255], [255, 255, 255]]))
    assert {r["label"] for r in found.collect()} == {0, 1}
    snake = [[0 if y % 2 == 0 or x == (0 if y % 4 == 1 else 14) else 255 for x in range(15)] for y in range(15)]
    assert {r["label"] for r in A.connected_components(image(snake)).filter("label > 0").collect()} == {1}


def test_medial_axis_and_morphology(image):
    bar = image([[255] * 7, [255, 0, 0, 0, 0, 0, 255], [255, 0, 0, 0, 0, 0, 255], [255, 0, 0, 0, 0, 0, 255], [255] * 7])
    axis = [v == 0 for v in data(N.medial_axis(N.distance_map(bar)))]
    assert axis[2 * 7 + 3] and 0 < sum(axis) < 15
    assert data(N.morphology(bar, False)).count(0) == 3 and data(N.morphology(bar, True)).count(0) == 35


def test_dtw():
    rng = np.random.default_rng(1)
    a, b = rng.random((9, 4)), rng.random((12, 4))
    (same, _), (cost, path) = V.alignments([a, a], [a, b])
    assert same == 0 and cost > 0
    assert tuple(path[-1]) == (8, 11) and (np.diff(path, axis=0) >= 0).all()


def test_morph_cost():
    grid = np.zeros((10, 14), bool)
    grid[2:8, 3], grid[2, 3:10] = True, True
    other = np.roll(grid, 2, axis=1)
    noise = np.random.default_rng(2).random((10, 14)) < 0.3
    a, b, c = map(morph.Side.of, (grid, other, noise))
    same, moved, unlike, back = morph.full_costs([a, a, a, b], [a, b, c, a])
    assert abs(same) < 1e-9 and moved < unlike and abs(moved - back) < 1e-9


def test_merges_against_greedy_pass(spark):
    rng = np.random.default_rng(3)
    cost = {(i, j): int(rng.integers(1, 40)) for i, j in itertools.combinations(range(14), 2)}
    alive, want = set(range(14)), []
    for c, i, j in sorted((c, i, j) for (i, j), c in cost.items()):
        if i in alive and j in alive:
            want.append((i, j, c))
            alive.discard(j)
    matrix = spark.createDataFrame([(i, j, c) for (i, j), c in cost.items()], "i long, j long, cost long")
    merged = C.merges(matrix)
    assert [(r["i"], r["j"], r["cost"]) for r in C.steps(merged).orderBy("step").collect()] == want
    nodes = {r["node"]: r for r in C.tree_nodes(merged, matrix).collect()}
    root = next(n for n, r in nodes.items() if r["parent"] is None)
    assert nodes[root]["n_words"] == 14 and len(nodes) == 14


def test_netpbm_round_trip(spark, tmp_path):
    raw = pnm.encode_pnm(3, 2, 1, 255, ["DProp:label=a=b", "DProp:threshold=90", "note"], [0, 1, 2, 253, 254, 255])
    assert pnm.decode_pnm(raw)[1:] == (3, 2, 1, 255, ["DProp:label=a=b", "DProp:threshold=90", "note"], [0, 1, 2, 253, 254, 255])
    for args in ((2, 1, 3, 255, [], [1, 2, 3, 4, 5, 6]), (2, 1, 1, 65535, [], [1, 65535])):
        for plain in (True, False):
            assert pnm.decode_pnm(pnm.encode_pnm(*args, plain=plain))[1:] == args
    (tmp_path / "w_00000012.pgm").write_bytes(raw)
    r = pnm.read_pnm(spark, str(tmp_path)).first()
    assert r["image_id"] == 12 and r["props"] == {"label": "a=b", "threshold": "90"} and list(r["data"]) == [0, 1, 2, 253, 254, 255]
    again = pnm.with_pnm(pnm.read_pnm(spark, str(tmp_path))).first()
    assert bytes(again["content"]) == raw


def test_gnt(spark, tmp_path):
    record = lambda tag, w, h, body: (10 + w * h).to_bytes(4, "little") + bytes(tag) + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes(body)
    (tmp_path / "001-f.gnt").write_bytes(record((1, 200), 2, 2, [1, 2, 3, 4]) + record((7, 8), 1, 1, [9]))
    rows = pnm.read_gnt(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["label"], r["width"], list(r["data"])) for r in rows] == [(0, "001200", 2, [1, 2, 3, 4]), (1, "007008", 1, [9])]


def png(rows, channels):
    """A PNG file of 8-bit samples, without filters."""
    import struct
    import zlib

    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    head = struct.pack(">IIBBBBB", len(rows[0]) // channels, len(rows), 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")


def test_pictures(spark, tmp_path):
    (tmp_path / "a_7.png").write_bytes(png([[255, 0, 10, 1, 2, 3], [4, 5, 6, 7, 8, 9]], 3))
    (tmp_path / "b_8.png").write_bytes(png([[0, 9, 255]], 1))
    (tmp_path / "c_9.png").write_bytes(b"no picture")
    found = pictures.read_pictures(spark, str(tmp_path)).orderBy("image_id")
    assert [(r["image_id"], r["width"], r["height"], r["channels"], list(r["data"])) for r in found.collect()] == [(7, 2, 2, 3, [255, 0, 10, 1, 2, 3, 4, 5, 6, 7, 8, 9]), (8, 3, 1, 1, [0, 9, 255])]
    assert [list(r["blue"]) for r in pictures.planes(found).orderBy("image_id").collect()] == [[10, 3, 6, 9], [0, 9, 255]]
    assert N.rgb_edges(pictures.planes(found)).count() == 2


@pytest.mark.parametrize(("theta", "r", "ends"), [
    (0, 3, (0, 3, 9, 3)), (90, 4, (4, 0, 4, 4)), (45, 0, (0, 0, 0, 0)), (135, 0, (0, 0, 4, 4)), (45, 50, (-1, -1, -1, -1)), (45, 2 ** 0.5, (0, 2, 2, 0)), (135, 2 * 2 ** 0.5, (4, 0, 8, 4)), (135, -2 * 2 ** 0.5, (0, 4, 0, 4)),
])
def test_line_ends(spark, theta, r, ends):
    row = spark.range(1).select(samples.line_ends(F.lit(10), F.lit(5), F.lit(float(r)), F.lit(theta)).alias("e")).first()["e"]
    got = tuple(row)
    assert got == pytest.approx(tuple(map(float, ends)), abs=1e-9)


def test_distances_of_random_images(spark, image):
    rng = np.random.default_rng(5)
    grid = np.where(rng.random((9, 13)) < 0.15, 0, 255)
    ink = np.argwhere(grid == 0)
    back = np.argwhere(grid != 0)
    to = lambda spots, y, x: int(np.abs(spots - (y, x)).sum(1).min())
    want = [1 - to(back, y, x) if grid[y, x] == 0 else to(ink, y, x) for y in range(9) for x in range(13)]
    assert data(N.distance_map(image(grid.tolist()))) == want
    labels = spark.createDataFrame([(1, y, x, int(rng.integers(1, 5)) if grid[y, x] == 0 else 0) for y in range(9) for x in range(13)] + [(2, 0, 0, 0)], "image_id long, y int, x int, label int")
    spots = [(r["y"], r["x"], r["label"]) for r in labels.collect() if r["label"]]
    for r in A.nearest_component(labels).collect():
        near = min((abs(r["y"] - y) + abs(r["x"] - x), k) for y, x, k in spots) if r["image_id"] == 1 else (None, None)
        assert (r["distance"], r["nearest"]) == near


def test_set_pixel_outside(image):
    rows = image([[1, 2], [3, 4]])
    assert [data(G.set_pixel(rows, *xy, 9)) for xy in ((1, 0), (2, 0), (-1, 1), (0, 2))] == [[1, 9, 3, 4]] + [[1, 2, 3, 4]] * 3


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_compares_few_in_tight_clusters(spark, monkeypatch, broadcast):
    """Level by level: children are compared unless their centre's distance less its radius exceeds the best."""
    if not broadcast:
        monkeypatch.setattr(C, "TREE_SAMPLES", 0)
    rng = np.random.default_rng(9)
    near = lambda k, n: (60 * k + rng.integers(0, 6, (n, 4))).tolist()
    vectors = [v for k in range(4) for v in near(k, 5)]
    train = spark.createDataFrame([(i, i // 5, v) for i, v in enumerate(vectors)], "image_id long, label int, data array<int>")
    asked = [v for k in range(4) for v in near(k, 2)]
    tests = spark.createDataFrame([(100 + i, i // 2, v) for i, v in enumerate(asked)], "image_id long, label int, data array<int>")
    far = lambda a, b: int(((np.array(a) - b) ** 2).sum())
    matrix = spark.createDataFrame([(i, j, far(vectors[i], vectors[j])) for i, j in itertools.combinations(range(20), 2)], "i long, j long, cost long")
    nodes = C.tree_nodes(C.merges(matrix), matrix)
    below, radius = {}, {}
    for r in nodes.collect():
        below.setdefault(r["parent"], []).append(r["node"])
        radius[r["node"]] = r["max_dist"] ** 0.5
    found = C.search(tests, train, nodes)
    for r in found.collect():
        a = asked[r["test_id"] - 100]
        front, best, compared = below[None], (10**9, -1), 0
        while front:
            compared += len(front)
            best = min([best, *((far(a, vectors[n]), n) for n in front)])
            front = [k for n in front if far(a, vectors[n]) ** 0.5 - radius[n] <= best[0] ** 0.5 + 1e-9 for k in below.get(n, [])]
        assert (r["cost"], r["train_id"], r["compared"]) == (*best, compared) and best == min((far(a, v), i) for i, v in enumerate(vectors))
    stats = C.search_statistics(found, tests, train).first()
    assert stats["n_test"] == 8 and stats["n_train"] == 20 and stats["pct_right"] == 100 and stats["mean_compared"] < 20


#: Edges of an image whose variances at -7 to -4 degrees are the same by exact arithmetic, and halfway between two places of nine digits.
HALFWAY = [30, 71, 92, 51, 10, 36, 27, 47, 112, 121, 76, 26, 34, 18, 46, 103, 160, 42, 61, 20, 25, 5, 28, 13, 71, 47, 54, 14, 20, 28, 41, 64, 66, 16, 75, 20, 13, 41, 15, 15, 34, 67, 59, 69, 63, 77, 37, 86, 79, 54, 32, 50, 31, 33, 22, 50, 22, 68, 111, 30, 68, 120, 80, 48]


def test_equal_variances_tie_whatever_the_order_of_rows(spark):
    df = spark.createDataFrame([(k, 8, 8, HALFWAY) for k in range(40)], "image_id long, width int, height int, data array<int>")
    found = A.skew_variance(df, [-7, -6, -5, -4]).collect()
    assert {r["variance"] for r in found} == {238.416992188} and len(found) == 160


def test_matrices_and_their_chunks_by_tiles(spark, monkeypatch):
    for name, n in (("TILE", 7), ("BLOCK", 3), ("STRIP", 10)):
        monkeypatch.setattr(M, name, n)
    values = np.random.default_rng(3).integers(0, 256, (23, 5))
    df = spark.createDataFrame([(k * 3 + 1, v.tolist()) for k, v in enumerate(values)], "image_id long, data array<int>")
    cost = {(a * 3 + 1, b * 3 + 1): int(((values[a] - values[b]) ** 2).sum()) for a, b in itertools.combinations(range(23), 2)}
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    matrix = M.cost_matrix(df)
    assert rows(matrix) == sorted((*p, c) for p, c in cost.items())
    assert rows(M.symmetric_matrix(df)) == sorted([(*p, c) for p, c in cost.items()] + [(j, i, c) for (i, j), c in cost.items()] + [(k * 3 + 1, k * 3 + 1, 0) for k in range(23)])
    chunks = ["i % 4 in (0, 1)", "i % 8 in (1, 2)"]
    found = M.matrix_of_chunks(df, chunks)
    assert rows(found) == rows(M.union_chunks([matrix.filter(c) for c in chunks]))
    assert "HashAggregate(keys=[i" not in found._jdf.queryExecution().executedPlan().toString()  # no cell is shuffled
    assert sorted(r["i"] for r in M.matrix_rows(df).collect()) == sorted({i for i, _ in cost})
    assert "MapInPandas" not in M.matrix_rows(df)._jdf.queryExecution().executedPlan().toString()
