"""Connected components of an edge list, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of ``edges`` (a, b).

    Each round takes the least label among neighbours and then follows labels one step; chains shrink by half, stars
    end at once. Rounds stop when no label changes. Edges meet the one label of their far end in a join that AQE can split
    at a hub; grouping by the near end pre-aggregates before its shuffle.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        lower = labels.join(near, "node").select("node", F.least("component", "seen").alias("component"), F.col("component").alias("before"))
        lower = settle(lower)
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = lower.join(jump, "component", "left").select("node", F.least(F.coalesce("next", "component"), "component").alias("component"), "before")
        labels = settle(moved)
        if labels.where("component <> before").isEmpty():
            return labels.select("node", "component")
