"""Connected components by propagating the smallest label, in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (a, b); the label is the component's smallest node.

    Every round takes the smallest label among the neighbours and then that label's own
    label, so the rounds needed grow with the logarithm of a component's width in practice.
    """
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
                  .union(edges.select("b", "a")).where("x <> y").distinct())
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y"))
                    .select("node", F.least("node", "y").alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("y"), "label"), "y")
                .groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                 F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = stored(lower.join(root, "label").select("node", "old", F.least("label", "root").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels
