"""Connected components by smallest labels and pointer jumping, as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the label is the smallest node it is linked to.

    Labels only fall, each round takes the smallest label of all neighbours and then that label's own
    label, so chains halve from round to round. Nothing but a count of changes reaches the driver.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        step = step.join(up, F.col("new") == F.col("up"), "left").select(
            "node", "label", F.least("new", "up_label").alias("new"))
        step = saved(step, "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new < label").isEmpty():
            return labels
