"""Connected components of an edge table, as joins and minimum aggregations; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import discard, stored


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node reachable.

    Each round gives a node, and the node that its label names, the smallest label among its neighbours, then lets
    labels point to the labels of their labels. The distance to a component's smallest node about halves each round;
    every round is written to the shared folder, so a lost executor costs one round at most.
    """
    both = stored(spark, edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = stored(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("best"))
        seen = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "best").alias("best"))
        offers = seen.select("node", "best").union(seen.where("best < label").select(F.col("label"), F.col("best"))).groupBy("node").agg(F.min("best").alias("best"))
        offers = stored(spark, offers, "offers")
        jump = offers.select(F.col("node").alias("via"), F.col("best").alias("next"))
        new = stored(spark, offers.join(jump, F.col("best") == F.col("via"), "left").select("node", F.least("best", F.coalesce("next", "best")).alias("label")), "labels")
        changed = new.alias("n").join(labels.alias("o"), "node").where("n.label <> o.label").limit(1).count()
        discard(spark, offers, labels)
        labels = new
        if not changed:
            discard(spark, both)
            return labels
