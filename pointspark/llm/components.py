"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import save


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so chains shorten by doubling.  A round is written as
    a table; a hub's edges are reduced by partial aggregation.

    Defined results: edges with a null end are no edges; repeated edges and
    edges both ways count once; a loop is a node of its own; an empty table
    gives an empty result; other columns are not looked at.
    """
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = save(edges.union(edges.select(F.col("b"), F.col("a"))).toDF("node", "other").distinct(), "links")
    labels = save(both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("root")), "labels")
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("root").alias("near"))
        near = both.join(of_other, "other").groupBy("node").agg(F.min("near").alias("near"))
        met = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        of_root = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = met.join(of_root, "root").select("node", F.least("root", "above").alias("root"), (F.least("root", "above") < F.col("was")).alias("moved"))
        labels = save(moved, "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "root")
