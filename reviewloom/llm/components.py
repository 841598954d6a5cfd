"""Connected components of an edge table by contraction, as Spark jobs; no edge or label reaches the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.scratch import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) of any ordered type -> (id, component): every vertex with an edge and the least vertex it reaches.

    Each round hooks every vertex to its least smaller neighbour, shortens the chains by doubling and contracts the edges;
    at most half of the vertices of a component that still has edges are left, so rounds grow with the logarithm.
    """
    left = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("component", F.col("id"))
    labels = stage(labels, "labels")
    while not left.isEmpty():
        parent = stage(left.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("root")), "parents")
        while True:
            up = parent.select(F.col("child").alias("root"), F.col("root").alias("next"))
            jumped = stage(parent.join(up, "root", "left").select("child", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "parents")
            parent = jumped.select("child", "root")
            if jumped.where("moved").isEmpty():
                break
        for end in ("a", "b"):
            to = parent.select(F.col("child").alias(end), F.col("root").alias("to"))
            left = left.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = stage(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        to = parent.select(F.col("child").alias("component"), F.col("root").alias("to"))
        labels = stage(labels.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
    return labels
