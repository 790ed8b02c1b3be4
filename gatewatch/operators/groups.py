"""Rows that must be worked on together: connected components of links between group numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import kept


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of links (a, b): the least number that it is connected with. A round takes the least label around a node,
    then that label's own label; what a round gives is written and reread, so plans don't grow. A link of many nodes to one is a star, whose
    hub's rows are pre-aggregated like any others."""
    edges = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("new"))
        above = labels.select(F.col("node").alias("new"), F.col("label").alias("top"))
        moved = kept(hooked.join(above, "new").select("node", F.least("new", "top").alias("now"), F.col("label").alias("before")))
        labels = moved.select("node", F.col("now").alias("label"))
        if moved.filter("now <> before").isEmpty():
            return labels
