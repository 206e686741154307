"""Connected components by minimum labels and pointer jumping, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the smallest node that each can reach.

    Every round takes the least label of a node's neighbours and then the label of its label, so paths shorten by
    half or better; labels are written to the shared folder after each round.  Rows of a node with many links
    are reduced before they are shuffled.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, "links")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = label.join(near, "node").select("node", "component", F.least("component", "near").alias("lower"))
        lower = materialise(lower, "labels")
        jump = lower.select(F.col("node").alias("lower"), F.col("lower").alias("lowest"))
        after = materialise(lower.join(jump, "lower").select("node", "component", "lowest"), "labels")
        label = after.select("node", F.col("lowest").alias("component"))
        if not after.where("component <> lowest").limit(1).count():
            return label
