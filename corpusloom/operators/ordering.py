"""Dense numbers for sorted keys without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.shared import stored


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows sorted by range over many tasks and stored, with their range (_part) and place in it (_place)."""
    placed = stored(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    return placed.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def _before(placed: DataFrame, total: Column) -> DataFrame:
    """What the ranges before each range hold; there are as many as shuffle partitions, so they go to the rows."""
    sizes = placed.groupBy("_part").agg(total.alias("_n"))
    return F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")))


def numbered(keys: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """keys with gapless numbers from 1 in the given order: the place in a sorted range and the sizes of those before."""
    placed = _placed(keys, order, "numbered")
    return placed.join(_before(placed, F.count("*")), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def running(rows: DataFrame, order: list[str], weight: str, name: str = "before") -> DataFrame:
    """rows with the sum of weight over all rows before them in the given order."""
    placed = _placed(rows, order, "running")
    inside = F.coalesce(F.sum(weight).over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_inside", inside).join(_before(placed, F.sum(weight)), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_place", "_inside", "_before")
