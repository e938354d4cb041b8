"""Connected components of a table of links, by rounds of joins: no links and no components reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shared import written


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a long, b long), any order, repeats allowed. Returns (node, component): the smallest node that each node reaches.

    A node that no link names isn't returned; an empty table gives an empty one. Each round hangs every node on its smallest neighbour, if that is smaller than itself,
    jumps from pointer to pointer until all point to the root of their tree, and shrinks every tree to its root; links between roots go to the next round, until none are left. A root that keeps
    a link has taken in another node in this round or isn't the smallest of its neighbours in the next, so two rounds at least halve the nodes that have links: rounds, and jumps in each, grow
    with the logarithm of the nodes, whatever their order, and need no cap. Pointers are aggregated by min() before any shuffle and a hub's links are one side of an equi-join,
    which adaptive execution splits, so a hub with a third of all links isn't one task.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "cc-links")
    trees: list[DataFrame] = []
    while not trees or not both.isEmpty():
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "cc-up")
        changed = True
        while changed:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("changed")), "cc-jump")
            changed = not jumped.where("changed").isEmpty()
            up = jumped.select("node", "root")
        trees.append(up)
        ends = both.join(up.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        both = written(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-links")
    labels = trees.pop().withColumnRenamed("root", "component")
    while trees:
        above = labels.select(F.col("node").alias("root"), "component")
        labels = written(trees.pop().join(above, "root", "left").select("node", F.coalesce("component", "root").alias("component")), "cc-labels")
    return labels
