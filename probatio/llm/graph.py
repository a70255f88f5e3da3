"""Connected components of an undirected graph, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); some node names it.

    Each round every node moves to its least neighbour, and to where that one moved, if
    that is less than itself; nodes that meet are one from then on and edges between them go.
    So the edges shrink from round to round.  Only whether any is left reaches the driver.
    """
    edges = stage(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = stage(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                  .withColumn("component", F.col("node")), "nodes")
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("next"))
        near = stage(near, "near")
        ahead = near.select(F.col("node").alias("next"), F.col("next").alias("after"))
        moved = stage(near.join(ahead, "next").select("node", F.col("after").alias("to")), "moved")
        found = stage(found.join(moved.withColumnRenamed("node", "component"), "component",
                                 "left").select(
            "node", F.coalesce("to", "component").alias("component")), "components")
        left = edges.join(moved.select(F.col("node").alias("a"), F.col("to").alias("left")), "a")
        right = left.join(moved.select(F.col("node").alias("b"), F.col("to").alias("right")), "b")
        edges = stage(right.where("left <> right").select(
            F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"))
            .distinct(), "edges")
    return found
