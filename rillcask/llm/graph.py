"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, stored_sum


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component), for every node of ``edges`` (a, b).

    Each round a node takes the smallest label among its neighbours, then the label of its label,
    so paths shorten by half. Labels are written every round: the plan stays short, a lost
    executor costs one round, and the joins read plain shuffles whose hot keys Spark can split.
    Ends when the sum of the labels, which only falls, stops falling.
    """
    both = stored(
        edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        .distinct(), "edges",
    )
    labels, total = stored_sum(
        both.groupBy("node").agg(F.min("near").alias("low"))
        .select("node", F.least("node", "low").alias("label")), "labels", "label",
    )
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "near"), "near")
            .groupBy("node").agg(F.min("label").alias("low"))
        )
        labels = stored(
            labels.join(heard, "node").select("node", F.least("label", "low").alias("label")),
            "labels",
        )
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels, now = stored_sum(
            labels.join(above, "label").select("node", F.col("up").alias("label")), "labels", "label"
        )
        if now == total:
            return labels
        total = now
