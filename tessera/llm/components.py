"""Connected components of a graph in DataFrames: least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node long, component long), the smallest node reachable, for every node that has a link.

    Each round takes the least label among a node's neighbours and then the label of that label, so chains
    shorten by more than half; the labels are written to the shared folder each round. Nulls and loops count as no link.
    Every join is of tables that grow with the graph: they are dealt by key, so none of them passes through the driver.
    """
    both = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.hint("merge").join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.hint("merge").join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = stored(step.hint("merge").join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) < F.col("label")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
