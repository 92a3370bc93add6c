"""Vectors by chunk in a table of buckets: upserts and deletions rewrite the touched buckets only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import stored

BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _replaced(path: str, rows: DataFrame, touched: DataFrame) -> None:
    """Writes the touched buckets' rows over them; a bucket without rows goes. rows may come from the table: they are stored first."""
    spark = rows.sparkSession
    kept = stored(rows, "buckets")
    empty = [r["bucket"] for r in touched.join(kept.select("bucket").distinct(), "bucket", "left_anti").collect()]  # at most a row for each bucket
    kept.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in empty:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def upsert(path: str, rows: DataFrame, key: str = "chunk_id", buckets: int = BUCKETS) -> None:
    """Rows with a new key are added, others replace theirs. Rows without a key are left out; of rows of one key the greatest stays.

    The same rows once more leave the table as it is. The number of buckets is that of the first call.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != key]
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others)).alias("_row")).select(key, "_row.*")
    new = stored(one.withColumn("bucket", _bucket(key, buckets)), "upsert")
    touched = stored(new.select("bucket").distinct(), "touched")
    if not _exists(spark, path):
        return _replaced(path, new, touched)
    old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(new.select(key), key, "left_anti")
    _replaced(path, old.unionByName(new), touched)


def delete_run(path: str, spark: SparkSession, run_id: str) -> None:
    """All rows of a run go; buckets without any are not touched."""
    if not _exists(spark, path):
        return
    table = spark.read.parquet(path)
    touched = stored(table.where(F.col("run_id") == run_id).select("bucket").distinct(), "touched")
    kept = table.join(F.broadcast(touched), "bucket", "left_semi").where(~F.col("run_id").eqNullSafe(run_id))
    _replaced(path, kept, touched)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
