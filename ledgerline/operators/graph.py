"""Connected groups of small and middling graphs: labels spread along edges and jump along themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace


def connected(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """node, component (its smallest node) for every node of an edge; loops and nulls are ignored."""
    space = Workspace(edges.sparkSession, "connected")
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = space.write(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = space.replace(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = space.write(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "old"), "moved")
        changed = moved.where("label <> old").limit(1).count()
        labels = space.replace(moved.select("node", "label"), "labels")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components not stable")
