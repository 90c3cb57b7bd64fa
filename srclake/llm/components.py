"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of ``edges`` the smallest node it reaches.

    Each round gives a node the least label among itself and its neighbours
    (a partial aggregate, so a hot node never gathers in one task), then
    replaces labels by the labels of labels, which halves the remaining depth.
    Rounds are written to the shared folder. No edges: no rows.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = materialize(both.union(both.select("y", "x")).distinct(), "edges")
    label = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("m"))
        step = label.join(near, label.node == near.x).select("node", "root", F.least("root", "m").alias("to"))
        step = materialize(step, "step")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = step.join(jump, "to").select("node", F.least("to", "further").alias("new"), "root")
        after = materialize(after, "labels")
        changed = after.where("new <> root").limit(1).count()
        label = after.select("node", F.col("new").alias("root"))
        if not changed:
            return label
