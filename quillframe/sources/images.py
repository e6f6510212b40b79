"""Images as rows: (image_id, width, height, data), data being the samples row by row as an array of int.

Operators work on this form inside the row wherever a neighbourhood is bounded, so that no pixel is
shuffled; `pixels` gives the exploded relation for what is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def embeddings_as_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as labelled 8 x 8 images: v = clamp(floor((e + 0.6) * 212.5), 0, 255)."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    sample = lambda e: F.least(F.greatest(F.floor((e.cast("double") + 0.6) * 212.5), F.lit(0)), F.lit(255)).cast("int")
    return table.select(F.col("vec_id").alias("image_id"), "label", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.transform("embedding", sample).alias("data"))


def pixels(images: DataFrame, *keep: str) -> DataFrame:
    """(image_id, *keep, y, x, v)."""
    rows = images.select("image_id", *keep, "width", F.posexplode("data").alias("at", "v"))
    return rows.select("image_id", *keep, F.expr("at div width").cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), "v")


def at(y: Column, x: Column) -> Column:
    """The sample at a place inside the image."""
    return F.get(F.col("data"), y * F.col("width") + x)


def clamped(y: Column, x: Column) -> Column:
    """The sample at a place, borders repeated outside."""
    inside = lambda k, size: F.least(F.greatest(k, F.lit(0)), F.col(size) - 1)
    return at(inside(y, "height"), inside(x, "width"))


def inside(y: Column, x: Column) -> Column:
    return (y >= 0) & (x >= 0) & (y < F.col("height")) & (x < F.col("width"))


def settled(df: DataFrame) -> DataFrame:
    """df as a step of its own. Else Catalyst copies its array expressions into the lambdas of the next step, which would evaluate them for every element."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def from_pixels(images: DataFrame, value, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """images with data made anew: value(y, x) gives each sample; width and height may change with it."""
    w, h = width if width is not None else F.col("width"), height if height is not None else F.col("height")
    made = F.flatten(F.transform(F.sequence(F.lit(0), h.cast("int") - 1), lambda y: F.transform(F.sequence(F.lit(0), w.cast("int") - 1), lambda x: value(y, x))))
    others = [c for c in images.columns if c not in ("width", "height", "data")]
    # In two steps, so that the samples' expressions see the old width and height.
    new = images.select(*others, w.cast("int").alias("_new_width"), h.cast("int").alias("_new_height"), made.alias("_new_data"))
    return settled(new).select(*others, F.col("_new_width").alias("width"), F.col("_new_height").alias("height"), F.col("_new_data").alias("data"))
