"""Iterations over links: cycles of chains and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.shared import stored


def reaches_itself(chain: DataFrame) -> DataFrame:
    """Nodes of a chain (node, next) from which a cycle is reached; of several next ones of a node the least counts.

    Chains that end are peeled: a node whose next is not among those left goes. Pointers double in length each
    round, so rounds grow as the logarithm of the longest chain.
    """
    at = stored(chain.groupBy("node").agg(F.min("next").alias("next")), "chain")
    left = -1
    while True:
        n = at.count()
        if n == left or n == 0:
            return at.select("node")
        left = n
        for _ in range(2):
            further = at.select(F.col("node").alias("next"), F.col("next").alias("_far"))
            at = at.join(further, "next").select("node", F.col("_far").alias("next"))
        at = stored(at, "chain")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its lowest node) of undirected edges (a, b).

    Joins exchange both sides: labels are as many as nodes, and each broadcast of them goes through the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = stored(labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = stored(lower.join(jump.hint("merge"), "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("old <> label").limit(1).count():
            return labels.withColumnRenamed("label", "component")
