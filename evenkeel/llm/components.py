"""Connected components of a graph of links, by contraction.

In each round every node takes the smallest node it is linked to, if that is smaller than itself,
and goes three steps further down this way; nodes and links are rewritten to where they end.
Links inside one place vanish, and the rest go on with the smaller graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (columns ``a``, ``b``); root is one of its component."""
    both = lambda df: df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(links.select("a", "b").where(F.col("a") != F.col("b")), "links")
    roots = both(edges).select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        least = both(edges).groupBy("a").agg(F.min("b").alias("b"))
        parents = written(least.select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents")
        down = steps_down(parents, 3)
        to = down.select(F.col("node").alias("root"), "parent")
        roots = written(roots.join(to, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
        side = lambda name: down.select(F.col("node").alias(name), F.col("parent").alias(f"to_{name}"))
        moved = edges.join(side("a"), "a").join(side("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = written(moved.where(F.col("a") != F.col("b")).distinct(), "links")
    return roots


def steps_down(parents: DataFrame, steps: int) -> DataFrame:
    """``node, parent`` with each parent replaced by its own parent, so many times over."""
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
    for _ in range(steps):
        parents = parents.join(above, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent"))
    return parents
