"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.snapshots import Steps


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, its smaller end first, without loops."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of (a, b); the component is its least node.

    In each round every node hooks onto its least neighbour, if that is smaller, and trees are flattened by pointer jumping; then the graph is
    contracted to the trees' roots, so that the next round sees only links between different trees.  A star is done after one round, and a
    chain shrinks to its local minima.  What a round makes is stored in the shared folder.
    """
    steps = Steps(links.sparkSession)
    edges = steps.keep(_ordered(links))
    labels = links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    for level in range(max_rounds):
        if not edges.limit(1).count():
            return steps.result(labels)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = steps.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent")))
        for _ in range(max_rounds):
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            jumped = steps.keep(parents.join(above, "parent").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")))
            parents = jumped.select("node", "parent")
            if not jumped.where("moved").limit(1).count():
                break
        root = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))
        if level:
            labels = labels.join(root("component"), "component", "left").select("node", F.coalesce("component_root", "component").alias("component"))
        else:
            labels = parents.select("node", F.col("parent").alias("component"))
        labels = steps.keep(labels)
        contracted = edges.join(root("a"), "a").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        edges = steps.keep(_ordered(contracted))
    raise RuntimeError(f"components didn't settle within {max_rounds} rounds")
