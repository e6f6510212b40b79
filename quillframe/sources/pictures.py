"""Pictures that Spark's own image reader decodes (PNG, JPEG, BMP, GIF and what else the JVM reads), in this engine's form."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


@F.pandas_udf(ArrayType(IntegerType()))
def _samples(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Bytes as samples; blue, green, red (and alpha) become red, green, blue (and alpha)."""

    def one(raw: bytes, n: int) -> np.ndarray:
        cells = np.frombuffer(raw, np.uint8).reshape(-1, n)
        return cells[:, [2, 1, 0, 3][:n] if n > 1 else [0]].ravel().astype(np.int32)

    return pd.Series([None if d is None else one(bytes(d), int(n)) for d, n in zip(data, channels)], dtype=object)


def from_image_rows(rows: DataFrame) -> DataFrame:
    """(image_id, path, width, height, channels, data) of rows with the image source's column `image`; image_id from the digits before the suffix."""
    number = F.regexp_extract("image.origin", r"(\d+)\.[^./]*$", 1)
    return rows.select(
        F.when(number != "", number.cast("long")).alias("image_id"), F.col("image.origin").alias("path"), "image.width", "image.height",
        F.col("image.nChannels").alias("channels"), _samples("image.data", "image.nChannels").alias("data"),
    )


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file below path that can be decoded; others are left out."""
    return from_image_rows(spark.read.format("image").option("dropInvalid", True).load(path))


def planes(pictures: DataFrame) -> DataFrame:
    """Pictures of three or four channels with their samples as red, green and blue, and grey ones in all three."""
    plane = lambda k: F.filter("data", lambda v, i: i % F.col("channels") == (F.when(F.col("channels") >= 3, k).otherwise(0)))
    return pictures.select("image_id", "width", "height", *[plane(k).alias(c) for k, c in enumerate(("red", "green", "blue"))])


#: What a PNG file starts with, and its colour types by channels. Fixed values of the format.
PNG_START = b"\x89PNG\r\n\x1a\n"
PNG_COLOURS = {1: 0, 2: 4, 3: 2, 4: 6}


def encode_png(width: int, height: int, channels: int, data: np.ndarray, level: int = 6) -> bytes:
    """A PNG file of 8-bit samples, row by row, or of 16-bit ones if some are larger than 255."""
    wide = len(data) > 0 and int(np.max(data)) > 255
    rows = np.asarray(data).astype(">u2" if wide else np.uint8).reshape(height, -1)
    plain = np.concatenate([np.zeros((height, 1), np.uint8), rows.view(np.uint8).reshape(height, -1)], axis=1)  # each row after its filter, none

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 16 if wide else 8, PNG_COLOURS[channels], 0, 0, 0)
    return PNG_START + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(plain.tobytes(), level)) + chunk(b"IEND", b"")


def with_png(images: DataFrame, column: str = "content", level: int = 6) -> DataFrame:
    """images (width, height, data, and channels, 1 without it) with their PNG file as a binary column."""

    @F.pandas_udf("binary")
    def encoded(w: pd.Series, h: pd.Series, c: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else encode_png(int(x), int(y), int(n), np.asarray(d), level) for x, y, n, d in zip(w, h, c, data)], dtype=object)

    channels = F.col("channels") if "channels" in images.columns else F.lit(1)
    return images.withColumn(column, encoded("width", "height", channels, "data"))
