"""Connected components of a large graph by joins: smallest label among neighbours, then the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the label is the least node of its component.

    Each round writes one row per node and stops when no label fell. Following the label's label halves the distance
    to the least node, so the rounds grow with the logarithm of a component's width.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut(both.where("a <> b").distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        seen = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = cut(seen.join(own, F.col("label") == F.col("at"), "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("label < old").isEmpty():
            return labels
