"""Connected components by minimum-label propagation with pointer jumping, in tables.

Each round is two equi-joins and partial minima over written tables, so a lost executor costs at
most one round, and a vertex of very many edges is only the hot key of a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for each id in an edge."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        hop = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        hop = written(hop, "hop")
        jump = hop.select(F.col("id").alias("to"), F.col("label").alias("over"))
        new = hop.join(jump, hop["label"] == jump["to"], "left").select("id", "old", F.least("label", "over").alias("component"))
        new = written(new, "labels")
        moved = new.where("component <> old").limit(1).count()
        remove(edges.sparkSession, labels, hop)
        labels = new.select("id", "component")
        if not moved:
            remove(edges.sparkSession, both)
            return labels
