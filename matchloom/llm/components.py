"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(links: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) for every node of ``links`` (columns a, b; longs).

    Every round hands each node the smallest label around it and then lets
    labels jump to the labels of the nodes they name, so the rounds follow the
    logarithm of a path's length. Hubs meet only partial aggregates and joins
    that may be split. Null ends are left out; an empty table gives no node.
    """
    links = links.where("a is not null and b is not null")
    ways = saved(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a"))).distinct()
    )
    labels = saved(ways.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")))
    while True:
        around = (
            ways.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = saved(
            step.join(jump, "next", "left").select(
                "node", F.col("label").alias("was"), F.least("next", F.coalesce("far", "next")).alias("label")
            )
        )
        changed = moved.where("was <> label").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
