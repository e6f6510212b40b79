"""Image files of any kind that this engine reads, told by their first bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.sources.pictures import read_pictures, with_png
from quillframe.sources.pnm import file_format, read_pnm, with_pnm


def formats(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, named): what each file below path is, and what its name says."""
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = F.when(suffix.isin("pgm", "ppm", "pnm", "pbm"), "pnm").when(suffix.isin("jpg", "jpeg"), "jpg").when(suffix.isin("tif", "tiff"), "tiff").when(suffix.isin("png", "gif", "bmp"), suffix)
    return files.select("path", file_format(F.col("content")).alias("format"), named.alias("named"))


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, width, height, channels, data, props) of the netpbm files and of the pictures that Spark's reader decodes, whatever their names; other files are left out."""
    columns = ["image_id", "path", "width", "height", "channels", "data"]
    plain = read_pnm(spark, path).select(*columns, "props")
    none = F.lit(None).cast("map<string,string>").alias("props")
    return plain.union(read_pictures(spark, path).select(*columns, none))


def with_file(images: DataFrame, kind: str, column: str = "content") -> DataFrame:
    """images with their file of a kind, pnm or png, as a binary column."""
    if kind == "png":
        return with_png(images, column)
    if kind == "pnm":
        return with_pnm(images, column=column)
    raise ValueError(f"{kind} can't be written")
