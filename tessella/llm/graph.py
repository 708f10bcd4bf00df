"""Connected components by joins: smallest labels spread over links and pointers are shortened in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize


def components(links: DataFrame, rows: int) -> DataFrame:
    """(node, label) for the nodes of ``links`` (columns a, b; at most ``rows``); the label is the smallest node of the component.

    Each round takes the smallest label of all neighbours, then the label of that label. Every table is written to the
    shared folder, so the lineage stays one round long. Labels only fall, and the rounds end when none does.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", 2 * rows)
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels", 2 * rows)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("_node"), F.col("label").alias("_up"))
        jumped = step.join(up, F.col("label") == F.col("_node"), "left").select(
            "node", F.least("label", F.coalesce("_up", "label")).alias("label"), (F.least("label", F.coalesce("_up", "label")) < F.col("old")).alias("fell")
        )
        jumped = materialize(jumped, "labels", 2 * rows)
        labels = jumped.select("node", "label")
        if jumped.filter("fell").isEmpty():
            return labels
