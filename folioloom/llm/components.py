"""Connected components by contraction: every node joins the smallest of its neighbours, and the edges shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, root: one row for each node that has an edge, root being the same for connected nodes.

    A round groups edges by node (summed up in each task first), maps each node to the least of itself and its
    neighbours and rewrites the edges by these maps, until none joins two different nodes. Each round is written
    to the shared folder. Self loops and null ends have no effect.
    """
    edges = staged(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        step = staged(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("root"))
        else:
            labels = labels.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = staged(labels, "labels")
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = staged(moved.filter("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
