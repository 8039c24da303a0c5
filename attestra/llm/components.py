"""Connected components by repeated contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.plans.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node of `edges` (columns a and b); root is the same within a component and only there.

    Each round, a node takes the least of itself and its neighbours, and edges are drawn between what was taken.
    Chains shrink by a constant factor a round on average and a star is gone after two; labels are then followed
    down the rounds. Loops and repeated edges are fine; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("to")).union(e.select("b", "a"))
    label = None
    while True:
        step = staged(both(edges).groupBy("node").agg(F.least("node", F.min("to")).alias("root")))
        if label is None:
            label = step
        else:
            down = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            label = label.join(down, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = staged(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return label
