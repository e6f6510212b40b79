"""Stored matrices, text reports, record and size readers, PNG files."""

import itertools
import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.operators import aggregates
from quillframe.sources import load, pictures, pnm, reports
from quillframe.sources.matrices import ImageMatrixStore, MatrixStore


def matrix(spark, n):
    return spark.createDataFrame([(i, j, float(i * 100 + j)) for i, j in itertools.combinations(range(n), 2)], "i long, j long, cost double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_store_refuses_overlap_and_reads_few_files(spark, tmp_path):
    whole, store = matrix(spark, 40), MatrixStore(spark, f"file://{tmp_path}/m", 8)
    assert store.read().count() == 0 and store.chunks() == []
    for first, last in ((0, 11), (24, 39)):
        store.write(whole.filter(F.col("i").between(first, last)), first, last)
    assert [(r["first_missing"], r["last_missing"]) for r in store.missing(0, 39).collect()] == [(12, 23)]
    for first, last in ((11, 12), (0, 39), (30, 31), (20, 24)):
        with pytest.raises(ValueError, match="overlap"):
            store.write(whole.limit(0), first, last)
    with pytest.raises(ValueError, match="outside"):
        store.write(whole.filter("i < 20"), 12, 19)
    store.write(whole.filter(F.col("i").between(12, 23)), 12, 23)
    assert store.missing(0, 39).count() == 0 and rows(store.read()) == rows(whole)
    some = store.read(16, 23)
    assert rows(some) == rows(whole.filter("i between 16 and 23 and j between 16 and 23"))
    assert {f.split("part=")[1].split("/")[0] for f in (r["f"] for r in some.select(F.input_file_name().alias("f")).distinct().collect())} == {"2"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "part" in filters and "chunk" in filters and "GreaterThanOrEqual(i,16)" in plan


def test_chunk_that_was_stopped_is_written_again(spark, tmp_path):
    whole, store = matrix(spark, 12), MatrixStore(spark, f"file://{tmp_path}/m", 4)
    store.write(whole.filter("i < 6"), 0, 5)
    half = whole.filter("i between 6 and 8").select("i", "j", (F.col("cost") + 1).alias("cost"), F.expr("i div 4").alias("part"), F.lit(6).alias("chunk"))
    half.write.mode("append").partitionBy("chunk", "part").parquet(f"file://{tmp_path}/m/rows")  # stopped before its chunk was noted
    assert rows(store.read()) == rows(whole.filter("i < 6"))
    store.write(whole.filter("i >= 6"), 6, 11)
    assert rows(store.read()) == rows(whole)


def test_matrix_of_images_is_stored_by_rows(spark, tmp_path):
    """Every cell of the written rows comes back, those with columns of chunks to come too, and no cell is on disk."""
    rng = np.random.default_rng(4)
    values = rng.integers(0, 256, (40, 6))
    images = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "image_id long, data array<int>")
    cells = [(i, j, float(((values[i] - values[j]) ** 2).sum())) for i, j in itertools.combinations(range(40), 2)]
    store = ImageMatrixStore(spark, f"file://{tmp_path}/m", 8)
    store.write_columns(images)
    assert store.read().count() == 0
    for first, last in ((0, 12), (20, 39)):
        store.write(images.filter(F.col("image_id").between(first, last)), first, last)
    assert rows(store.read()) == [c for c in cells if not 12 < c[0] < 20]
    assert rows(store.read(10, 24)) == [c for c in cells if 10 <= c[0] and c[1] <= 24 and not 12 < c[0] < 20]
    for first, last, what in ((12, 13, "overlap"), (13, 18, "outside")):
        with pytest.raises(ValueError, match=what):
            store.write(images.filter("image_id > 12 and image_id < 20"), first, last)
    store.write(images.filter("image_id between 13 and 19"), 13, 19)
    assert rows(store.read()) == cells and store.missing(0, 39).count() == 0
    assert sum(spark.read.parquet(f"file://{tmp_path}/m/{t}").count() for t in ("rows", "columns")) == 80


def words(spark, ids, names="abc"):
    return spark.createDataFrame([(k, names[k % len(names)] + " #x"[: k % 4]) for k in ids], "image_id long, label string")


def report(spark, tmp_path, name="r", tests=range(10, 17), train=range(3, 8), comment="a path/ trained", names="abc", of_a_file=5):
    costs = spark.createDataFrame([(t, k, ((t * 7 + k * 3) % 11) / 4, float((t + k) % 3)) for t in tests for k in train], "test_id long, train_id long, cost_morph double, cost_dp double")
    lines = reports.report_lines(costs, words(spark, tests), words(spark, train, names), comment, 12.345, of_a_file)
    reports.write_reports(lines, f"file://{tmp_path}/{name}")
    return costs


def test_report_round_trip(spark, tmp_path):
    costs = report(spark, tmp_path)
    files = {int(p.parent.name.split("=")[1]): p.read_text().split("\n") for p in tmp_path.glob("r/report=*/*.txt")}
    assert sorted(files) == [2, 3]
    text = files[3]
    assert text[:7] == ["#a path/ trained", "walltime: 12.35" if "12.35" in text[1] else "walltime: 12.34", "trainFirst: 00000003 trainLast: 00000007", "testFirst: 00000015 testLast: 00000016", "#15 ------", "#a #x", "# bestMorph=w_00000006.pgm[a #]0.500000   bestDP=w_00000003.pgm[a #x]0.000000"]
    assert text[10:13] == ["15 :", f"   {(105 + 9) % 11 / 4:.6f} 0.000000", f"   {(105 + 12) % 11 / 4:.6f} 1.000000"]
    at = text.index("#training labels:")
    assert text[at : at + 3] == ["#training labels:", "#3", "a #x"] and text[-1] == ""
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        found = reports.read_reports(spark, f"file://{tmp_path}/r")
    assert rows(found.matches) == rows(costs) and rows(found.tests) == rows(words(spark, range(10, 17))) and rows(found.train) == rows(words(spark, range(3, 8)))
    assert [tuple(r)[1:] for r in found.headers.orderBy("test_first").collect()] == [("a path/ trained", 12.35 if "12.35" in text[1] else 12.34, 3, 7, a, b) for a, b in ((10, 14), (15, 16))]


def test_reports_that_dont_agree(spark, tmp_path):
    def both(**other):
        path = tmp_path / f"c{len(list(tmp_path.iterdir()))}"
        path.mkdir()
        report(spark, path, "one")
        report(spark, path, "two", **{"tests": range(20, 22)} | other)
        return f"file://{path}"

    with pytest.warns(UserWarning, match="comments"):
        assert reports.read_reports(spark, both(comment="another")).matches.count() == 45
    for other, what in (({"train": range(3, 7)}, "training words"), ({"tests": range(16, 18)}, "several"), ({"names": "xyz"}, "training labels")):
        with pytest.raises(ValueError, match=what):
            reports.read_reports(spark, both(**other))
    path = tmp_path / "cut"
    path.mkdir()
    report(spark, path)
    one = next(path.glob("r/report=3/*.txt"))
    (path / "cut.txt").write_text("\n".join(one.read_text().split("\n")[:-4]))
    with pytest.raises(ValueError, match="header"):
        reports.read_reports(spark, f"file://{path}/cut.txt")


def test_report_without_wall_time(spark, tmp_path):
    costs = report(spark, tmp_path, of_a_file=1000)
    one = next(tmp_path.glob("r/report=0/*.txt"))
    lines = one.read_text().split("\n")
    (tmp_path / "old.txt").write_text("\n".join(lines[:1] + lines[2:]))
    found = reports.read_reports(spark, f"file://{tmp_path}/old.txt")
    assert rows(found.matches) == rows(costs) and found.headers.first()["seconds"] is None


def gnt(tag, w, h, body):
    return (10 + w * h).to_bytes(4, "little") + bytes(tag) + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes(body)


def test_records_are_decoded_as_asked_for(spark, tmp_path, monkeypatch):
    for name, n in (("001-f.gnt", 9), ("002-f.gnt", 4)):
        (tmp_path / name).write_bytes(b"".join(gnt((k, 7), k % 3 + 1, 2, [k] * (2 * (k % 3 + 1))) for k in range(n)))
    every = pnm.read_gnt(spark, str(tmp_path)).orderBy("path", "pos").collect()
    assert [(r["pos"], r["width"], list(r["data"])) for r in every] == [(k, k % 3 + 1, [k] * (2 * (k % 3 + 1))) for n in (9, 4) for k in range(n)]
    assert [(r["path"][-9:], r["pos"], r["label"]) for r in pnm.read_gnt(spark, str(tmp_path), 5, 5).collect()] == [("001-f.gnt", 5, "005007")]
    heads = pnm.read_gnt(spark, str(tmp_path), samples=False)
    assert heads.columns == ["path", "pos", "label", "width", "height"] and heads.count() == 13
    (tmp_path / "003-f.gnt").write_bytes(gnt((1, 1), 2, 2, [1, 2, 3]))
    with pytest.raises(Exception, match="breaks off"):
        pnm.read_gnt(spark, str(tmp_path)).collect()


def test_sizes_come_from_headers(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# one\n30 20\n255\n")  # no samples at all
    (tmp_path / "b.ppm").write_bytes(b"P3 2 1 # two\n65535\n1 2 3 4 5 6\n")
    (tmp_path / "c.pgm").write_bytes(b"P2\n" + b"# " + b"x" * 9000 + b"\n4 5\n9\n" + b"1 " * 20)
    (tmp_path / "d.txt").write_bytes(b"no picture")
    got = {r["path"][-5:]: tuple(r)[1:] for r in pnm.pnm_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.pgm": ("P5", 30, 20, 1, 255), "b.ppm": ("P3", 2, 1, 3, 65535), "c.pgm": ("P2", 4, 5, 1, 9)}


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = [(1, 5, 4, 1, rng.integers(0, 256, 20).tolist()), (2, 3, 2, 3, rng.integers(0, 256, 18).tolist()), (3, 2, 2, 4, rng.integers(1, 256, 16).tolist()), (4, 300, 200, 1, rng.integers(0, 256, 60_000).tolist())]
    df = spark.createDataFrame(images, "image_id long, width int, height int, channels int, data array<int>")
    for r in pictures.with_png(df).collect():
        (tmp_path / f"w_{r['image_id']}.png").write_bytes(bytes(r["content"]))
    back = pictures.read_pictures(spark, str(tmp_path)).orderBy("image_id").collect()
    assert [(r["image_id"], r["width"], r["height"], r["channels"], list(r["data"])) for r in back] == images
    assert pictures.with_png(df.drop("channels").filter("image_id = 1")).first()["content"] == pictures.encode_png(5, 4, 1, images[0][4])
    wide = pictures.encode_png(2, 1, 1, [1, 40_000])
    assert wide[24] == 16 and zlib.decompress(wide[41:-16]) == bytes([0, 0, 1, *divmod(40_000, 256)])


def test_files_of_several_kinds(spark, tmp_path):
    (tmp_path / "w_1.pgm").write_bytes(b"P5\n#DProp:label=a\n2 1\n255\n\x05\x06")
    (tmp_path / "w_2.png").write_bytes(pictures.encode_png(1, 2, 1, [7, 8]))
    (tmp_path / "w_3.jpg").write_bytes(pictures.encode_png(1, 1, 1, [9]))  # its name is wrong
    (tmp_path / "w_4.txt").write_bytes(b"text")
    got = {r["image_id"]: (r["width"], r["height"], r["channels"], list(r["data"]), r["props"]) for r in load.load_images(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1, 1, [5, 6], {"label": "a"}), 2: (1, 2, 1, [7, 8], None), 3: (1, 1, 1, [9], None)}
    kinds = {r["path"][-7:]: (r["format"], r["named"]) for r in load.formats(spark, str(tmp_path)).collect()}
    assert kinds == {"w_1.pgm": ("pnm", "pnm"), "w_2.png": ("png", "png"), "w_3.jpg": ("png", "jpg"), "w_4.txt": (None, None)}
    again = load.with_file(pnm.read_pnm(spark, str(tmp_path)), "png").first()
    assert bytes(again["content"]) == pictures.encode_png(2, 1, 1, [5, 6])
    assert bytes(load.with_file(pnm.read_pnm(spark, str(tmp_path)), "pnm").first()["content"]) == (tmp_path / "w_1.pgm").read_bytes()
    with pytest.raises(ValueError, match="gif"):
        load.with_file(pnm.read_pnm(spark, str(tmp_path)), "gif")


def test_unusable_images_fail(spark, tmp_path):
    for k, ok in ((1, "1"), (2, None)):
        (tmp_path / f"w_{k}.pgm").write_bytes(b"P5\n" + (f"#DProp:textlineExtractionOK={ok}\n".encode() if ok else b"") + b"1 1\n255\n\x05")
    assert pnm.checked(pnm.read_pnm(spark, str(tmp_path))).count() == 2
    (tmp_path / "w_3.pgm").write_bytes(b"P5\n#DProp:textlineExtractionOK=0\n1 1\n255\n\x05")
    with pytest.raises(Exception, match="textlineExtractionOK is 0 in image 3"):
        pnm.checked(pnm.read_pnm(spark, str(tmp_path))).count()


def test_stretching_clips_tails(spark):
    values = [[0, 10, 20, 30, 40, 50, 60, 70, 80, 255], [7, 7, 7], [5]]
    df = spark.createDataFrame([(k, len(v), 1, v) for k, v in enumerate(values)], "image_id long, width int, height int, data array<int>")
    for low, high, p, q in ((0, 255, 0.0, 0.0), (10, 200, 0.2, 0.15), (0, 100, 1.0, 1.0)):
        got = {r["image_id"]: list(r["data"]) for r in aggregates.stretched(df, low, high, p, q).collect()}
        for k, v in enumerate(values):
            order, n = sorted(v), len(v)
            at = lambda share: max(int(np.ceil(share * n)), 1)  # noqa: B023, E731
            a, b = order[at(p) - 1], order[n - at(q)]
            scale = (high - low) / (b - a) if b > a else 1
            assert got[k] == [int(min(max(round((x - a) * scale + low, 9), low), high)) for x in v]
