"""Image files: netpbm (P2, P3, P5, P6) and GNT character records, read with binaryFile and written as binary columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What starts a comment that holds a property. A fixed value of the format.
PROP = "DProp:"
_TOKEN = re.compile(rb"(?:\s|#([^\n]*)\n)*(\d+)")

IMAGE = "path string, magic string, width int, height int, channels int, top int, comments array<string>, data array<int>"


def file_format(content: Column) -> Column:
    """pnm, png, jpg, tiff, gif, bmp or null, by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    starts = lambda *hexes: head.rlike("^(" + "|".join(hexes) + ")")
    return (
        F.when(starts("503[1-6]"), "pnm").when(starts("89504E47"), "png").when(starts("FFD8FF"), "jpg")
        .when(starts("49492A00", "4D4D002A"), "tiff").when(starts("47494638"), "gif").when(starts("424D"), "bmp")
    )


def decode_pnm(raw: bytes) -> tuple[str, int, int, int, int, list[str], list[int]]:
    """Magic, width, height, channels, largest sample, comments without #, and samples."""
    magic = raw[:2].decode("latin-1")
    if magic not in ("P2", "P3", "P5", "P6"):
        raise ValueError(f"not a supported netpbm file: {magic!r}")
    at, numbers, comments = 2, [], []
    while len(numbers) < 3:
        found = _TOKEN.match(raw, at)
        if found is None:
            raise ValueError("header breaks off")
        comments += [c.decode("utf-8", "replace").rstrip("\r") for c in re.findall(rb"#([^\n]*)\n", raw[at : found.start(2)])]
        numbers.append(int(found.group(2)))
        at = found.end()
    width, height, top = numbers
    channels = 3 if magic in ("P3", "P6") else 1
    n = width * height * channels
    if magic in ("P2", "P3"):
        samples = np.array(re.sub(rb"#[^\n]*", b"", raw[at:]).split(), np.int64)[:n]
    else:
        samples = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, min(n, (len(raw) - at - 1) // (2 if top > 255 else 1)), at + 1)
    if len(samples) != n:
        raise ValueError(f"{len(samples)} samples of {n}")
    return magic, width, height, channels, top, comments, samples.astype(int).tolist()


def encode_pnm(width: int, height: int, channels: int, top: int, comments: list[str], data: list[int], plain: bool = False) -> bytes:
    magic = {(1, True): "P2", (3, True): "P3", (1, False): "P5", (3, False): "P6"}[channels, plain]
    head = f"{magic}\n" + "".join(f"#{c}\n" for c in comments) + f"{width} {height}\n{top}\n"
    body = (" ".join(map(str, data)) + "\n").encode() if plain else np.asarray(data).astype(">u2" if top > 255 else np.uint8).tobytes()
    return head.encode() + body


def read_pnm(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file below path; image_id from the digits before the suffix, props from comments."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *decode_pnm(bytes(c))) for p, c in zip(batch["path"], batch["content"])], columns=["path", "magic", "width", "height", "channels", "top", "comments", "data"])

    images = files.filter(file_format(F.col("content")) == "pnm").mapInPandas(decoded, IMAGE)
    number = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1)
    return images.select(F.when(number != "", number.cast("long")).alias("image_id"), "*", props(F.col("comments")).alias("props"))


def props(comments: Column) -> Column:
    """DProp:k=v comments as a map, split at the first =; of repeated keys the last counts."""
    held = F.filter(comments, lambda c: c.startswith(PROP) & c.contains("="))
    pairs = F.transform(held, lambda c: F.split(F.substring(c, len(PROP) + 1, 1 << 20), "=", 2))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: F.get(q, F.lit(0)) == F.get(p, F.lit(0))))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))


def checked(images: DataFrame, key: str = "textlineExtractionOK", bad: str = "0") -> DataFrame:
    """images, of which none may have a property that says it is unusable: a job that meets one fails with its id."""
    wrong = F.concat(F.lit(f"{key} is {bad} in image "), F.coalesce(F.col("image_id").cast("string"), F.col("path")))
    good = F.assert_true(~F.coalesce(F.trim(F.col("props")[key]) == bad, F.lit(False)), wrong)
    return images.filter(good.isNull())  # assert_true gives null or fails


def with_pnm(images: DataFrame, plain: bool = False, column: str = "content") -> DataFrame:
    """images with their file as a binary column."""

    @F.pandas_udf("binary")
    def encoded(w: pd.Series, h: pd.Series, c: pd.Series, t: pd.Series, notes: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([encode_pnm(*x[:4], list(x[4]), x[5], plain) for x in zip(w, h, c, t, notes, data)])

    return images.withColumn(column, encoded("width", "height", "channels", "top", "comments", "data"))


def header_of(raw: bytes) -> tuple[str, int, int, int, int] | None:
    """Magic, width, height, channels and largest sample of the first bytes of a netpbm file; None if they aren't all there."""
    at, numbers = 2, []
    while len(numbers) < 3:
        found = _TOKEN.match(raw, at)
        if found is None or found.end() == len(raw):
            return None
        numbers.append(int(found.group(2)))
        at = found.end()
    magic = raw[:2].decode("latin-1")
    return magic, numbers[0], numbers[1], 3 if magic in ("P3", "P6") else 1, numbers[2]


def pnm_sizes(spark: SparkSession, path: str, head: int = 4096) -> DataFrame:
    """(path, magic, width, height, channels, top) of each file below path, from its header: the first head bytes, or as many more as comments take. No sample is decoded."""
    files = spark.read.format("binaryFile").load(path)
    files = files.filter(file_format(F.col("content")) == "pnm")
    first, all_of_it = F.substring("content", 1, head), F.col("content")

    @F.pandas_udf("magic string, width int, height int, channels int, top int")
    def sizes(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_of(bytes(r)) or (None,) * 5 for r in raw], columns=["magic", "width", "height", "channels", "top"])

    told = files.select("path", "length", sizes(first).alias("s"))
    short = told.filter(F.col("s.magic").isNull() & (F.col("length") > head)).select("path")
    whole = files.join(F.broadcast(short), "path").select("path", sizes(all_of_it).alias("s"))  # files whose comments are longer than that
    return told.filter("s.magic is not null").select("path", "s.*").union(whole.select("path", "s.*"))


def _walk(name: str, raw: memoryview) -> Iterator[tuple[int, int, int, int]]:
    """(pos, offset, width, height) of each record, by their headers alone."""
    at, pos = 0, 0
    while at + 10 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "little")
        w, h = (int.from_bytes(raw[at + k : at + k + 2], "little") for k in (6, 8))
        if size != 10 + w * h or at + size > len(raw):
            raise ValueError(f"{name}: record {pos} breaks off")
        yield pos, at, w, h
        at, pos = at + size, pos + 1


#: Samples of records that leave a task at a time.
GNT_SAMPLES = 1 << 22


def read_gnt(spark: SparkSession, path: str, first: int = 0, last: int | None = None, samples: bool = True) -> DataFrame:
    """(path, pos, label, width, height, data) of the records first to last of each file; the label is both tag bytes as three digits each.

    Records leave a task some at a time, and only those asked for are decoded; without samples none is, and data is missing.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                raw, rows, held = memoryview(content), [], 0
                for pos, at, w, h in _walk(name, raw):
                    if last is not None and pos > last:
                        break
                    if pos < first:
                        continue
                    data = np.frombuffer(raw, np.uint8, w * h, at + 10).astype(np.int32) if samples else None
                    rows.append((name, pos, f"{raw[at + 4]:03d}{raw[at + 5]:03d}", w, h, data))
                    held += w * h if samples else 64
                    if held >= GNT_SAMPLES:
                        yield pd.DataFrame(rows, columns=["path", "pos", "label", "width", "height", "data"])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=["path", "pos", "label", "width", "height", "data"])

    found = files.mapInPandas(records, "path string, pos int, label string, width int, height int, data array<int>")
    return found if samples else found.drop("data")


def gnuplot_text(rows: DataFrame, every: int = 1) -> DataFrame:
    """(value) lines "x y v" of the pixel relation, each every-th row and column, for write.text."""
    return rows.filter((F.col("x") % every == 0) & (F.col("y") % every == 0)).select(F.concat_ws(" ", "x", "y", "v").alias("value"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(file_id) of white-space separated whole numbers."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).filter("w <> ''")
    return words.select(F.col("w").cast("int").alias("file_id"))
