"""Match graph connectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.storage import materialize


def label_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without edges are components of their own.

    Minimum labels spread along edges and then jump to their label's label, so long chains need few rounds. Edges are
    undirected; every round is one join and one partial aggregate.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both, "graph-edges")
    labels = materialize(nodes.select(F.col("node"), F.col("node").alias("component")).distinct(), "graph-labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels["node"] == near["u"], "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        up = spread.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = spread.join(up, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"))
        before, labels = labels, materialize(jumped, "graph-labels")
        changed = labels.join(before.withColumnRenamed("component", "old"), "node").filter("component <> old")
        if changed.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
