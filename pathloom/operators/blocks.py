"""Articulation points without gathering a component: a breadth-first forest by levels, numbers for its subtrees, and components of its edges.

Two tree edges are in one block (part that no single node cuts) if an edge outside the forest joins their subtrees. That makes a graph
over the tree edges, each named by its lower node, whose components are the blocks. Rounds are as many as the forest is deep.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .network import components, sent


def _levels(edges: DataFrame, roots: DataFrame, checkpoint) -> list[DataFrame]:
    """(node, parent) of each depth. What a level meets lies in the two levels before it, so only these are left out."""
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    levels = [checkpoint(roots.select("node", F.lit(None).cast("long").alias("parent")))]
    n = levels[0].count()
    while True:
        met = sent(levels[-1].select(F.col("node").alias("a")), n).join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        for known in levels[-2:]:
            met = met.join(known.select("node"), "node", "left_anti")
        met = checkpoint(met)
        n = met.count()
        if not n:
            return levels
        levels.append(met)


def _numbered(levels: list[DataFrame], checkpoint) -> list[DataFrame]:
    """(node, parent, size, pre): nodes of the subtree, and a place before all of them, after all of earlier ones; subtrees are intervals."""
    sized, below = [], None
    for level in reversed(levels):
        n = F.lit(1).cast("long")
        if below is not None:
            level = level.join(below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("_s")), "node", "left")
            n = n + F.coalesce("_s", F.lit(0).cast("long"))
        below = checkpoint(level.select("node", "parent", n.alias("size")))
        sized.append(below)
    out = []
    earlier = F.sum("size").over(W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1))
    for k, level in enumerate(reversed(sized)):
        if k == 0:
            numbers = level.withColumn("pre", F.lit(0).cast("long"))
        else:
            above = out[-1].select(F.col("node").alias("parent"), F.col("pre").alias("_p"))
            numbers = level.withColumn("_e", F.coalesce(earlier, F.lit(0).cast("long"))).join(above, "parent").select("node", "parent", "size", (F.col("_p") + 1 + F.col("_e")).alias("pre"))
        out.append(checkpoint(numbers))
    return out


def blocks(edges: DataFrame, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """(block, node) of edges (a, b): a node is in each block that it belongs to; loops and repeated edges count nothing."""
    edges = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    roots = components(edges, checkpoint=checkpoint, stored=True).where("node = label")
    levels = _numbered(_levels(edges, roots, checkpoint), checkpoint)
    forest = levels[0].withColumn("depth", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        forest = forest.unionByName(level.withColumn("depth", F.lit(k)))
    forest = checkpoint(forest)
    end = lambda n: forest.select(F.col("node").alias(n), F.col("parent").alias(f"{n}_parent"), F.col("pre").alias(f"{n}_pre"))
    across = checkpoint(edges.join(end("a"), "a").join(end("b"), "b").where("NOT (a_parent <=> b OR b_parent <=> a)"))
    sees = across.select(F.col("a").alias("node"), F.col("b_pre").alias("p")).unionByName(across.select(F.col("b").alias("node"), F.col("a_pre").alias("p"))).groupBy("node").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    own = checkpoint(forest.join(sees, "node", "left").select("node", "parent", "size", "pre", "depth", F.least("pre", "low").alias("low"), F.greatest("pre", "high").alias("high")))
    spans, below = [], None
    for k in reversed(range(len(levels))):
        level = own.where(F.col("depth") == k)
        if below is not None:
            under = below.groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("_l"), F.max("high").alias("_h"))
            level = level.join(under, "node", "left").withColumns({"low": F.least("low", "_l"), "high": F.greatest("high", "_h")}).drop("_l", "_h")
        below = checkpoint(level)
        spans.append(below)
    whole = spans[0]
    for level in spans[1:]:
        whole = whole.unionByName(level)
    above = forest.where("parent IS NOT NULL").select(F.col("node").alias("parent"), F.col("pre").alias("_pre"), F.col("size").alias("_size"))
    leaves = whole.join(above, "parent").where("low < _pre OR high >= _pre + _size").select(F.col("parent").alias("a"), F.col("node").alias("b"))
    # Edges of the forest are none of those across.
    linked = across.select("a", "b").unionByName(checkpoint(leaves.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    labels = components(linked, checkpoint=checkpoint, stored=True)
    named = forest.where("parent IS NOT NULL").join(labels, "node", "left").select(F.coalesce("label", "node").alias("block"), F.explode(F.array("node", "parent")).alias("node"))
    return named.distinct()


def articulation(edges: DataFrame, **how) -> DataFrame:
    """(node, blocks, articulation): a node of more than one block is what holds them together."""
    return blocks(edges, **how).groupBy("node").agg(F.count("*").alias("blocks")).withColumn("articulation", F.col("blocks") > 1)
