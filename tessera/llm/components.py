"""Connected components of a graph by contraction, over DataFrames.

In a round each node takes the least id among itself and its neighbours; edges move to those ids, loops and repeats
go. Ids are hashes, so on average fewer than half of the nodes of a component stay. A hub costs one aggregation with
partial results; joins are left to adaptive execution, which splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Edges of one file of a round.
FILE_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); ends in O(log nodes) rounds, as ids are random.

    A round writes its edges and parents to the shared folder; their number of files follows the count of edges.
    """
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    labels = None
    while n := edges.count():
        files = 1 + n // FILE_EDGES
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")).coalesce(files), "parents")
        left, right = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        if labels is None:
            labels = parent.select("node", F.col("up").alias("root"))
        else:
            labels = labels.join(parent.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        edges = materialize(edges.join(left, "a").join(right, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).where("a <> b").distinct().coalesce(files), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
