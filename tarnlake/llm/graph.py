"""Connected components of an edge table, wholly as DataFrame operations with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that edges (a, b: long) name; root is the smallest node of its component.

    Each round takes the smallest label among neighbours and then the label of that label, so paths halve. A
    round is written and reread; the loop ends when no label changes.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("low"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "low").alias("via"))
        hop = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = written(step.join(hop, "via", "left").select("node", "old", F.least("via", F.coalesce("far", "via")).alias("root")), "labels")
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
