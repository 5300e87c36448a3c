"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each end of the edges (a, b) the smallest node reachable from it.

    Each round takes the least label among neighbours (minima are combined before the shuffle, so a hub costs one
    row a task) and then the label's own label, which halves distances; labels are written each round. Rounds end
    when none changes, after about the logarithm of the longest path.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("c"), F.col("component").alias("old"))
        roots = labels.select(F.col("node").alias("c"), F.col("component").alias("root"))
        jumped = materialize(hooked.join(roots, "c", "left").select("node", F.least("c", F.coalesce("root", "c")).alias("component"), "old"))
        changed = jumped.where("component <> old").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
