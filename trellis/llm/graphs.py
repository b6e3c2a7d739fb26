"""Connected components over an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts


def connected_components(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(node, component) for every end of ``edges(a, b)``; component is the
    smallest node reachable.  No edges: no rows.

    Each round takes the least label among a node's neighbours (a partial
    aggregate, so a hub's edges are combined map-side), then replaces a label
    by its label's label, which halves the remaining depth.  The label table
    is written once per round and the previous one is dropped.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    links = cuts.cut(both.where("a <> b").distinct(), "links")
    labels = cuts.cut(
        links.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("component"))
        .withColumn("component", F.least("node", "component"))
        .withColumn("moved", F.lit(True)), "labels")
    while labels.where("moved").limit(1).count():
        near = (links.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        hooked = labels.join(near, "node").select(
            "node", F.col("component").alias("was"),
            F.least("component", "near").alias("hook"))
        jump = labels.select(F.col("node").alias("hook"), F.col("component").alias("far"))
        nxt = cuts.cut(
            hooked.join(jump, "hook", "left").select(
                "node", F.least("hook", "far").alias("component"),
                (F.least("hook", "far") != F.col("was")).alias("moved")), "labels")
        cuts.drop(labels)
        labels = nxt
    cuts.drop(links)
    return labels.select("node", "component")
