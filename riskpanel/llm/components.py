"""Connected components of an edge table, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to labels (node, label): label is the least node of the component. Nodes without an edge don't appear."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    held = labels = stored(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("_l"))
        near = both.join(of, "b").groupBy("a").agg(F.min("_l").alias("_near")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_new"))
        # A label is a node too: its own label is as good or better.
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_jump"))
        after = stored(lower.join(jump, "_new", "left").select("node", F.least("_new", F.coalesce("_jump", "_new")).alias("label"), (F.least("_new", F.coalesce("_jump", "_new")) != F.col("label")).alias("_changed")), "labels")
        dropped(held)
        held, labels = after, after.select("node", "label")
        if not after.filter("_changed").limit(1).count():
            dropped(both)
            return labels
