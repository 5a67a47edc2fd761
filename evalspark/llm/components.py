"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut


def components(edges: DataFrame, nodes: int) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) for every node of the undirected edges (``a``, ``b``).

    ``nodes`` is a bound on the number of nodes; ``edges`` is read several times. Each round takes the smallest label
    around every node, then that label's own label, until nothing changes: star and chain shapes both end in a few
    rounds. Nothing but the count of changes comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), nodes)
    while True:
        around = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        taken = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumps = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = cut(taken.join(jumps, "label").select("node", "old", F.least("label", "next").alias("label")), nodes)
        changed = moved.filter("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
