"""Connected components of a table of links, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.llm.common import settle


def _hooks(both: DataFrame) -> DataFrame:
    """Every vertex points to its smallest neighbour if that is smaller; then pointers are doubled until all end at a root."""
    tree = settle(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("root")))
    while True:
        up = tree.select(F.col("a").alias("root"), F.col("root").alias("up"))
        step = settle(tree.join(up, "root").select("a", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
        tree = step.drop("moved")
        if step.where("moved").isEmpty():
            return tree


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is one node of its component.

    Each round joins every component to its smallest neighbour and replaces links by links between roots, of which
    at least every second vanishes; the number of rounds grows with the logarithm of the number of nodes.
    Without links the result is empty.
    """
    edges = links.where("a != b").select("a", "b").distinct()
    labels = None
    while True:
        both = settle(edges.union(edges.select("b", "a")).distinct())
        if both.isEmpty():
            return labels if labels is not None else both.select(F.col("a").alias("node"), F.col("b").alias("root"))
        tree = _hooks(both)
        if labels is None:
            labels = tree.select(F.col("a").alias("node"), "root")
        else:
            step = tree.select(F.col("a").alias("root"), F.col("root").alias("up"))
            labels = settle(labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left = tree.select("a", F.col("root").alias("ra"))
        right = tree.select(F.col("a").alias("b"), F.col("root").alias("rb"))
        edges = both.join(left, "a").join(right, "b").where("ra < rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
