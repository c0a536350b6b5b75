"""From ways to edges, crossings and connected chains of edges."""
from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segments(ways: DataFrame) -> DataFrame:
    """(way, pos, a, b) of neighbours along a way; steps that stay at a node go."""
    w = W.partitionBy("way").orderBy("pos")
    return ways.select("way", "pos", F.col("node").alias("a"), F.lead("node").over(w).alias("b")).where("b IS NOT NULL AND a <> b")


def collapse(parts: DataFrame) -> DataFrame:
    """One row for each undirected edge: (a < b), its ways in order, and how often it is used."""
    return parts.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.array_sort(F.collect_set("way")).alias("ways"), F.count("*").alias("uses"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, crossing): a node of other than two edges is a crossing."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).withColumn("crossing", F.col("degree") != 2)


def components(edges: DataFrame, checkpoint=lambda df: df.checkpoint(), drop=lambda *old: None, stored: bool = False) -> DataFrame:
    """(node, label): the least node reachable. Roots take the least neighbour root, and edges move to the roots, until none is left.

    ``checkpoint`` cuts the lineage of each round's tables, ``drop`` is told of those that no later round reads.
    ``stored``: the edges are stored already, each once and with a < b.
    """
    if not stored:
        edges = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = checkpoint(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = checkpoint(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).where("to <> a").select(F.col("a").alias("root"), "to"))
        old = [labels, edges, to]
        labels = checkpoint(labels.join(to, labels.label == to.root, "left").select("node", F.coalesce("to", "label").alias("label")))
        moved = edges
        for end in ("a", "b"):
            moved = moved.join(to, moved[end] == to.root, "left").withColumn(end, F.coalesce("to", end)).select("a", "b")
        edges = checkpoint(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        drop(*old)
    drop(edges)
    return labels


def contigs(edges: DataFrame, **how) -> DataFrame:
    """(label, edges, nodes) of maximal chains: edges that meet at nodes that are no crossings belong together.

    Edges are the items; two share a chain when they share a node of degree two.
    """
    numbered = edges.select("a", "b", F.xxhash64("a", "b").alias("e"))
    ends = numbered.select("e", F.explode(F.array("a", "b")).alias("node"))
    through = ends.join(degrees(edges).where(~F.col("crossing")).select("node"), "node").groupBy("node").agg(F.min("e").alias("a"), F.max("e").alias("b"))
    labels = components(through.select("a", "b"), **how)
    named = numbered.join(labels, numbered.e == labels.node, "left").select("a", "b", F.coalesce("label", "e").alias("chain"))
    return named.groupBy("chain").agg(F.count("*").alias("edges"), F.min("a").alias("first_node"), F.max("b").alias("last_node"))


#: Up to so many rows, such as the new nodes of a round, are sent to every task, so that the arcs stay where they are.
FEW = 100_000


def sent(new: DataFrame, n: int) -> DataFrame:
    return F.broadcast(new) if n <= FEW else new


def reachable(edges: DataFrame, start: int, hops: int | None = None, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """(node, hops): fewest edges from ``start``, to ``hops`` at most where given. Each round joins only the new nodes, until there are none."""
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    seen = both.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("hops"))
    new, n = seen, 1
    for k in count(1) if hops is None else range(1, hops + 1):
        new = checkpoint(sent(new, n).join(both, new.node == both.a).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        n = new.count()
        if not n:
            break
        seen = checkpoint(seen.unionByName(new))
    return seen


def shortest(edges: DataFrame, start: int, hops: int | None = None, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """(node, distance): the least sum of lengths (a, b, length: not negative) over all paths, or over those of at most ``hops`` edges.

    Each round relaxes only what got nearer, until nothing does.
    """
    both = checkpoint(edges.select("a", "b", "length").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length")))
    best = both.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).cast("long").alias("distance"))
    new, n = best, 1
    for _ in count() if hops is None else range(hops):
        tried = sent(new, n).join(both, new.node == both.a).groupBy(F.col("b").alias("node")).agg(F.min(F.col("distance") + F.col("length")).alias("to"))
        new = checkpoint(tried.join(best, "node", "left").where("distance IS NULL OR `to` < distance").select("node", F.col("to").alias("distance")))
        n = new.count()
        if not n:
            break
        best = checkpoint(best.unionByName(new).groupBy("node").agg(F.min("distance").alias("distance")))
    return best


def bindings(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(way, contigs, status) of rules given as segments (way, pos, a, b): the contigs (edges a < b, contig) along each, runs collapsed.

    Status: ``exact`` for one contig, ``split`` for more, ``stale`` if a segment has no edge.
    """
    keyed = rules.select("way", "pos", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = keyed.join(edges.select("a", "b", "contig"), ["a", "b"], "left")
    new = ~F.col("contig").eqNullSafe(F.lag("contig").over(W.partitionBy("way").orderBy("pos")))
    path = found.withColumn("_n", new | (F.col("contig").isNull())).groupBy("way").agg(
        F.array_sort(F.collect_list(F.when(F.col("_n") & F.col("contig").isNotNull(), F.struct("pos", "contig")))).alias("s"), F.max(F.col("contig").isNull()).alias("stale"))
    status = F.when(F.col("stale"), "stale").when(F.size("s") == 1, "exact").otherwise("split")
    return path.select("way", F.transform("s", lambda x: x["contig"]).alias("contigs"), status.alias("status"))


def shared_edges(parts: DataFrame) -> DataFrame:
    """(a, b, ways) of edges that more than one way claims; an index by edge needs this to be empty."""
    return collapse(parts).where("size(ways) > 1").select("a", "b", F.size("ways").cast("long").alias("ways"))
