"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of each component, for all nodes of ``edges`` (``a``, ``b``).

    Each round takes the least label among a node and its neighbours, then
    the label of that label, so the distance covered doubles.  Each node is its own neighbour, so one grouping gives both
    its old and its new label.  Every round is written to the checkpoint folder; only whether a label changed goes to the driver.
    """
    ends = edges.select("a", "b").filter("a <> b")
    pairs = F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb"))))
    both = settle(ends.select(pairs.alias("_")).select("_.*").distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node"))
    while True:
        step = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(
            F.min("label").alias("new"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("label"))
        of = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        step = settle(step.join(of, "new").select(F.col("a").alias("node"), "label", F.least("new", "jump").alias("new")))
        labels = step.select("node", F.col("new").alias("label"))
        if step.filter("new <> label").isEmpty():
            return labels
