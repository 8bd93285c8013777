"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, every: int = 3) -> DataFrame:
    """(a, b) long pairs to (node, component), component the smallest node reachable.

    Each round a node takes the smallest label among its neighbours and then
    the label of that label, so long chains collapse in about log rounds. The
    joins are equi-joins, which adaptive execution splits where one node or one
    label holds most rows, and the minima combine before they are shuffled.
    Lineage is cut every round into the shared checkpoint folder.

    Empty input gives no rows; nulls and self-loops are ignored; repeated
    edges change nothing.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = cut(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        heard = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(both["a"].alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        hooked = labels.join(heard, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "heard").alias("near")
        )
        roots = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        stepped = cut(
            hooked.join(roots, "near").select("node", "old", F.least("near", "far").alias("component"))
        )
        changed = stepped.where("component <> old").limit(1).count()
        labels = stepped.select("node", "component")
        if not changed:
            return labels
