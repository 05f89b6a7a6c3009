"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every end of links (a, b): component is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of one's label, so
    that chains shorten by halves. A round is two joins and one aggregation with partial sums; its
    result is a table in the shared folder. The only thing on the driver is whether labels changed.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.save(both, "cc-links")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-0")
    turn = 0
    while True:
        turn += 1
        least = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(least, labels.node == least.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        over = labels.select(F.col("node").alias("label"), F.col("label").alias("over"))
        jumped = near.join(over, "label", "left").select("node", "old", F.least("label", "over").alias("label"))
        now = scratch.save(jumped, f"cc-{turn}")
        done = now.filter("label <> old").isEmpty()
        scratch.drop(f"cc-{turn - 1}")
        labels = now.select("node", "label")
        if done:
            scratch.drop("cc-links")
            return labels.select("node", F.col("label").alias("component"))
