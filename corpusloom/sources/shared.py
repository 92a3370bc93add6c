"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None

#: What Spark multiplies the size of files by to tell how large a table is, before it decides to send it to all executors.
SIZE_FACTOR = ("spark.sql.sources.fileCompressionFactor", "50")


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a folder of our own; a cluster has none to give."""
    global _own
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own is None:
        _own = Path(tempfile.mkdtemp(prefix="spark-shared-")).as_uri()
    return _own


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, where: str) -> None:
    """The path is removed when the driver ends: results read from it are lazy, so not before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(where)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is computed once and outlives executors."""
    spark = df.sparkSession
    where = path(spark, name)
    df.write.parquet(where)
    gone_at_exit(spark, where)
    return spark.read.schema(df.schema).parquet(where)


def removed(table: DataFrame) -> None:
    """Deletes a written table that no later step reads, before the driver ends."""
    spark = table.sparkSession
    for where in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(where)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """written(), for tables whose joins Spark plans by their size.

    Texts that repeat take a few hundredths of their room in Parquet. By the size of the files Spark would collect
    tables of hundreds of MB in the driver as broadcasts, so a session that states no factor for that size gets one;
    what turns out to be small after its exchange is still broadcast by its true size.
    """
    spark = df.sparkSession
    if float(spark.conf.get(SIZE_FACTOR[0])) == 1.0:
        spark.conf.set(*SIZE_FACTOR)
    return written(df, name)
