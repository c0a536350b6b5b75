"""Edges to contigs, ordered and numbered: chains between crossings, and cycles without one.

Places along a chain come from pointer doubling over directed edges: each looks at the one
before it, then two, four, ... before it, until it sees the chain's first. No chain is walked
in one task, and a chain of n edges takes log2 n joins.
"""
from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import network


def crossings(edges: DataFrame, signature: Column) -> DataFrame:
    """(node, degree) of nodes with other than two edges, or with two of different signature; edges are (a < b, ...)."""
    ends = edges.withColumn("_s", signature).select(F.explode(F.array("a", "b")).alias("node"), "_s")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.countDistinct("_s").alias("kinds")).where("degree <> 2 OR kinds <> 1").select("node", "degree")


def _half(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _placed(half: DataFrame, through: DataFrame, checkpoint) -> DataFrame:
    """(u, v, hu, hv, d, done) of edges in both directions: the edge hu-hv is ``d`` steps before it; done if hu is not one of ``through`` (u and its neighbours x and y)."""
    other = half.join(through, "u", "left")
    before = F.when(F.col("v") == F.col("x"), F.col("y")).otherwise(F.col("x"))
    state = checkpoint(other.select("u", "v", F.coalesce(before, "u").alias("hu"), F.when(F.col("x").isNull(), F.col("v")).otherwise(F.col("u")).alias("hv"), F.when(F.col("x").isNull(), 0).otherwise(1).cast("long").alias("d"), F.col("x").isNull().alias("done")))
    for _ in range(ceil(log2(max(2, state.count()))) + 1):
        if state.where("NOT done").isEmpty():
            break
        ahead = state.select(F.col("u").alias("hu"), F.col("v").alias("hv"), F.col("hu").alias("pu"), F.col("hv").alias("pv"), F.col("d").alias("pd"), F.col("done").alias("pdone"))
        moved = state.where("NOT done").join(ahead, ["hu", "hv"]).select("u", "v", F.col("pu").alias("hu"), F.col("pv").alias("hv"), (F.col("d") + F.col("pd")).alias("d"), F.col("pdone").alias("done"))
        state = checkpoint(state.where("done").unionByName(moved))
    return state


def _least_start(rows: DataFrame) -> DataFrame:
    """Of the two directions of each edge, the one whose chain starts at the least (crossing, neighbour)."""
    both = W.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("hu", "hv")
    return rows.withColumn("_k", F.row_number().over(both)).where("_k = 1").drop("_k")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with numbers from 1 in ``order``: sorted by range, and each range begins after the rows of those before it."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_m", 33)
    before, total = {}, 0
    for p, n in sorted(ranged.groupBy(part).count().collect()):  # a row for each partition
        before[p], total = total, total + n
    first = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), part) if before else F.lit(0)
    return ranged.withColumn(name, (first + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_m")


def _found(edges: DataFrame, signature: Column | None, checkpoint, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(contig, u, v, is_cycle) of each contig's first edge, and (contig, pos, u, v, is_cycle) of the later ones; both with the columns ``keep`` of their edges.

    An edge between two crossings is a contig of its own: it meets no other edge.
    """
    edges = checkpoint(edges.withColumn("_s", F.lit(0) if signature is None else signature).select("a", "b", "_s", *keep))
    side = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    ends = edges.select("_s", F.inline(F.array(side("a", "b"), side("b", "a")))).groupBy("u").agg(F.count("*").alias("n"), F.min("_s").alias("s"), F.max("_s").alias("t"), F.min("v").alias("x"), F.max("v").alias("y"))
    through = checkpoint(ends.where("n = 2 AND s = t").select("u", "x", "y"))
    few = network.sent(through, through.count())
    marked = edges.drop("_s")
    for end in ("a", "b"):
        marked = marked.join(few.select(F.col("u").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    alone = marked.where("_a IS NULL AND _b IS NULL").select(F.lit(False).alias("is_cycle"), F.col("a").alias("hu"), F.col("b").alias("hv"), *keep)
    chained = checkpoint(marked.where("_a OR _b").drop("_a", "_b"))
    rows = _placed(_half(chained), through, checkpoint)
    chains = _least_start(rows.where("done")).withColumn("is_cycle", F.lit(False))
    round_ = checkpoint(rows.where("NOT done AND u < v").select(F.col("u").alias("a"), F.col("v").alias("b")))
    if not round_.isEmpty():
        labels = network.components(round_, checkpoint=checkpoint)
        firsts = round_.join(labels, round_.a == labels.node).groupBy("label").agg(F.min(F.struct("a", "b")).alias("m")).select("m.a", "m.b")
        half = _half(round_)
        inner = half.join(firsts.select(F.col("a").alias("u")), "u", "left_anti").groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y"))
        cycles = _placed(half, inner, checkpoint).join(firsts.select(F.col("a").alias("hu"), F.col("b").alias("hv")), ["hu", "hv"], "left_semi")
        chains = chains.unionByName(cycles.withColumn("is_cycle", F.lit(True)))
    if keep:
        chains = chains.join(chained, (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b"))).drop("a", "b")
    chains = checkpoint(chains)
    heads = numbered(alone.unionByName(chains.where("d = 0").select(*alone.columns)), ["is_cycle", "hu", "hv"], "contig")
    later = checkpoint(chains.where("d > 0").join(heads.select("is_cycle", "hu", "hv", "contig"), ["is_cycle", "hu", "hv"]))
    return heads.select("contig", F.col("hu").alias("u"), F.col("hv").alias("v"), "is_cycle", *keep), later.select("contig", F.col("d").alias("pos"), "u", "v", "is_cycle", *keep)


def ordered(edges: DataFrame, signature: Column | None = None, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """(contig, pos, u, v, is_cycle) of edges (a < b, ...) along their contigs.

    A contig runs between crossings; ids follow its first crossing and the neighbour it leaves by, the least of both ends.
    Cycles without a crossing come after, by their least edge (a, b), and start there.
    """
    first, later = _found(edges, signature, checkpoint, ())
    return first.withColumn("pos", F.lit(0).cast("long")).select(*later.columns).unionByName(later)


def laid(edges: DataFrame, signature: Column | None = None, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """What ``records`` says of ``ordered`` edges (a, b, length_m, ways): edges keep their columns on the way, and contigs of one edge are not gathered."""
    first, later = _found(edges, signature, checkpoint, ("length_m", "ways"))
    long = later.select("contig").distinct()
    long = network.sent(long, later.count())
    single = first.join(long, "contig", "left_anti")
    ways = F.array_sort(F.array_distinct(F.coalesce("ways", F.array().cast("array<long>"))))
    own = single.select("contig", F.array("u", "v").alias("node_ids"), F.lit(1).cast("long").alias("segments"), F.round("length_m", 3).alias("length_m"), "is_cycle", ways.alias("way_ids"))
    many = first.join(long, "contig", "left_semi").withColumn("pos", F.lit(0).cast("long")).select(*later.columns).unionByName(later)
    return own.unionByName(_gathered(many))


def records(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(contig, node_ids, segments, length_m, is_cycle, way_ids) from the rows of ``ordered`` and edges (a, b, length_m, ways)."""
    known = steps.join(edges.select("a", "b", "length_m", "ways"), (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b")))
    return _gathered(known)


def _gathered(known: DataFrame) -> DataFrame:
    s = F.array_sort(F.collect_list(F.struct("pos", "u", "v")))
    g = known.groupBy("contig", "is_cycle").agg(s.alias("s"), F.count("*").alias("segments"), F.round(F.sum("length_m"), 3).alias("length_m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ways")))).alias("way_ids"))
    return g.select("contig", F.concat(F.array(F.col("s")[0]["u"]), F.transform("s", lambda x: x["v"])).alias("node_ids"), "segments", "length_m", "is_cycle", "way_ids")
