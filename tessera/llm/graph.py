"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stash


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): every node of an edge with its component's least node.

    Each round takes the least label among the neighbours and then the label
    of the label, both by joins and partial aggregation; a hub's edges are
    never gathered.  Rounds are written to the shared folder.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct()
    both = stash(both, "edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = stash(least.join(up, "label").select("node", "was", F.least("label", "up").alias("label")), "labels")
        if moved.where("label <> was").limit(1).count() == 0:
            return moved.select("node", F.col("label").alias("root"))
        labels = moved.select("node", "label")
