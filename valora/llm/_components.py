"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from valora.llm import _spark as S


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every end of an edge (a, b) the smallest node of its component.
    Labels are joined and aggregated by Spark only; each round is cut and cleaned of what has settled."""
    both = S.cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = S.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("low"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        # a label is a node of the same component: its own label may be smaller still
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = hooked.join(up, hooked.label == up.at, "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        done = S.cut(jumped)
        changed = done.where("old <> label").limit(1).count()
        labels = done.select("node", "label")
        if not changed:
            return labels
