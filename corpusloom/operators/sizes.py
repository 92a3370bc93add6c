"""Broadcasts of tables whose size has been counted."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else Spark chooses another join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tasks(df: DataFrame, each: int) -> int:
    """A task for every so many rows, and all cores at least."""
    return max(-(-df.count() // each), df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str, each: int) -> DataFrame:
    """df dealt by keys to a task for every so many rows, and to all cores at least.

    Small files are read by one task, and exchanges are joined up to a size of compressed bytes that says little of
    rows that repeat, so that what a task holds would grow with the input; here the number of tasks does.
    """
    return df.repartition(tasks(df, each), *keys)


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Joins planned within, of tables dealt by one of the join's keys to equally many tasks, do not exchange them by all keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    told = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, told)
