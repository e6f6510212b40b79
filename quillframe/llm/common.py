"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.sources.tables import freed, stored, thinned, written

__all__ = ["SPACES", "UPPER", "doc_key", "fold", "freed", "lower_ascii", "might_be_in", "read", "stored", "thinned", "written"]

#: Bits of a filter for each key, if they are no more than the most of them: 16 MB.
KEY_BITS, FILTER_BITS = 16, 1 << 27

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def doc_key(doc_id: Column) -> Column:
    """An id as text, for hashes; null is the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_key(doc_id).cast("binary")) % n


def might_be_in(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows whose columns hash like those of some row of keys, and so all that a join by them finds: fewer rows to shuffle."""
    return told_apart(rows, keys, *columns).filter("_might").drop("_might")


def told_apart(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """rows and _might: whether their columns hash like those of some row of keys.

    keys is written already. A bit for each hash is broadcast, FILTER_BITS at most: of rows without a key, n keys let n / bits through or less. If there are as many keys as bits, all rows might.
    """
    bits = 1 << 15
    n = keys.count()
    while bits < KEY_BITS * n and bits < FILTER_BITS:
        bits *= 2
    if n >= bits:
        return rows.withColumn("_might", F.lit(True))
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    maps = keys.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("_map")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumn("_place", place).withColumn("_at", F.expr("_place div 32768")).join(F.broadcast(maps), F.col("_at") == F.col("_map"), "left")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0
    return found.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias("_might"))
