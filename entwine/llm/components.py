"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b); the label is the least node reachable.

    Every round takes the least label among a node's neighbours and then jumps to
    that label's own label, so the rounds grow with the logarithm of the longest
    shortest path.  Minima are aggregated before the shuffle; joins on hubs are
    split by AQE.  Each round is written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.put(f"{name}-edges", both)
    labels = scratch.put(f"{name}-0", both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    step, before = 0, labels
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        after = low.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label"))
        after = scratch.put(f"{name}-{step}", after)
        done = after.where("label <> was").isEmpty()
        scratch.drop(f"{name}-{step - 1}")
        labels = after.select("node", "label")
        if done:
            scratch.drop(f"{name}-edges")
            return labels
