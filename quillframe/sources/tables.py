"""Tables written between the steps of iterative queries."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()
#: Tables written by this driver that haven't gone, in order.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one on a single machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one; it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/quillframe/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def remove() -> None:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)

        atexit.register(remove)
    return folder


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: cuts lineage and outlives executors. by: a column to write folders by."""
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The tables that stored() has written and that are there."""
    return list(_written)


def drop(spark: SparkSession, tables: list[str]) -> None:
    """Removes tables that nothing will read again."""
    for path in tables:
        remove(spark, path)
        _written.remove(path)


def thinned(table: DataFrame, path: str, *columns: str) -> DataFrame:
    """Some columns of a written table, written anew: the table in path goes, and with it the shuffles that nothing reads any more."""
    kept, spark = stored(table.select(*columns), "thinned"), table.sparkSession
    drop(spark, [path])
    freed(spark)
    return kept


def freed(spark: SparkSession) -> None:
    """Has shuffles that nothing will read again removed now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt to spark.sql.shuffle.partitions tasks: for rows that are small and costly, which adaptive execution would put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
