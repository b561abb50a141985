"""Connected components of an edge table by contraction, each round a few aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def contract(labels: DataFrame, links: DataFrame, keep: Scratch) -> DataFrame:
    """labels (node, label) with the labels of linked nodes merged into the least of each component.

    ``links`` (a, b) are pairs of nodes. In each round every label that still has links takes its least neighbour as
    parent if that is smaller; chains of parents are followed to their ends by doubling, and links between merged labels
    vanish. The least label is the end of every chain, as it never takes a parent. Tables are written each round; rounds
    and doublings are about the logarithm of a component's size.
    """
    ends = [labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in ("a", "b")]
    edges = links.join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    edges = keep.write(edges.where("a <> b").distinct())
    written = [edges]
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = keep.write(both.groupBy("a").agg(F.min("b").alias("parent")).where("parent < a").withColumnRenamed("a", "child"))
        while True:  # each parent's parent in its place, until none has one
            grand = parents.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
            jumped = keep.write(parents.join(grand, "parent", "left").select("child", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
            done = jumped.where("moved").isEmpty()
            keep.drop(parents)
            parents = jumped
            if done:
                break
        after = keep.write(
            labels.join(parents.select("child", "parent"), labels["label"] == parents["child"], "left").select("node", F.coalesce("parent", "label").alias("label"))
        )
        up = [parents.select(F.col("child").alias(x), F.col("parent").alias(f"p{x}")) for x in ("a", "b")]
        moved = edges.join(up[0], "a", "left").join(up[1], "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        edges_after = keep.write(moved.where("a <> b").distinct())
        if len(written) > 1:
            keep.drop(written.pop())
        keep.drop(edges, parents)
        written = [edges_after, after]
        labels, edges = after, edges_after
    keep.drop(edges)
    return labels
