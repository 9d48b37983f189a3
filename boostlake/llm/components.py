"""Connected components of a link table, by min-label propagation with pointer jumping over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlake.llm.blocks import drop, durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of the component.

    Each round takes the least label among a node and its neighbours, then the label of that label; labels are
    stored after each round. Ends when a round changes nothing.
    """
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = durable(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        held = durable(hooked, "labels")
        up = held.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = durable(held.join(up, "root", "left").select("node", "old", F.coalesce("up", "root").alias("root")), "labels")
        changed = after.where("root <> old").limit(1).count()
        drop(held)
        drop(labels)
        labels = after.select("node", "root")
        if not changed:
            drop(both)
            return labels
