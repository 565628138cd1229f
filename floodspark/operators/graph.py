"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.operators.kept import Kept


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component of all nodes (node): component is the least node that edges (a, b) reach.

    A round gives each node the least label around it, then the label of its label, so that chains shorten by
    more than half; each round is kept, and the last one changes nothing.
    """
    kept = Kept(edges.sparkSession)
    both = kept.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = kept.keep(nodes.select("node", F.col("node").alias("component"), F.lit(True).alias("moved")).distinct(), "labels")
    while not labels.filter("moved").isEmpty():
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.select("node", "component").join(around, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("before"), F.least("component", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        jump = step.join(of, "label", "left").select("node", F.least("label", "further").alias("component"), "before")
        labels = kept.keep(jump.select("node", "component", (F.col("component") < F.col("before")).alias("moved")), "labels")
    kept.drop("edges")
    return labels.select("node", "component")
