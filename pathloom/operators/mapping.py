"""Raw ways against boundary components: rings, membership, clipping, lengths by zone."""
from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine
from . import places

#: Metres around a boundary that still count, and the rules for which segments of a way stay.
BUFFER_M, ENDPOINT, MIDPOINT, ALL = 75.0, "inside_endpoint", "inside_midpoint", "all_segments"


def joined(fragments: list[list[int]]) -> list[list[int]]:
    """Closed rings from fragments of nodes, each used once. A line starts as the first unused fragment and grows from its last node, then from its first, by the earliest unused fragment that ends there."""
    lines = [f for f in fragments if len(f) > 1]
    unused, ending = dict.fromkeys(range(len(lines))), defaultdict(list)
    for k, f in enumerate(lines):
        for node in {f[0], f[-1]}:
            ending[node].append(k)

    def grown(line: list[int]) -> list[int]:
        while (k := next((k for k in ending[line[-1]] if k in unused), None)) is not None:
            del unused[k]
            f = lines[k] if lines[k][0] == line[-1] else lines[k][::-1]
            line += f[1:]
        return line

    found = []
    while unused:
        first = lines[next(iter(unused))]
        del unused[next(iter(unused))]
        tail, head = grown([*first]), grown([first[0]])
        ring = head[:0:-1] + tail
        if ring[0] == ring[-1]:
            found.append(ring)
    return found


def rings(members: DataFrame) -> DataFrame:
    """(component, kind, ring, nodes) of rows (component, kind, ord, nodes): one small group of fragments for each component and kind."""

    def assemble(pdf):
        import pandas as pd

        found = joined([list(n) for n in pdf.sort_values("ord")["nodes"]])
        return pd.DataFrame({"component": pdf["component"].iloc[0], "kind": pdf["kind"].iloc[0], "ring": range(len(found)), "nodes": found})

    return members.groupBy("component", "kind").applyInPandas(assemble, "component string, kind string, ring int, nodes array<bigint>")


def open_rings(closed: DataFrame) -> DataFrame:
    """Boundary ways (way, nodes) that are no closed ring of three corners; a boundary needs this to be empty."""
    return closed.where((F.size("nodes") < 4) | (F.col("nodes")[0] != F.element_at("nodes", -1)))


def ring_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, kind, ring, lon1, lat1, lon2, lat2) of the rings' edges; unknown nodes are left out before edges are drawn."""
    key = ["component", "kind", "ring"]
    at = found.select(*key, F.posexplode("nodes").alias("pos", "id")).join(nodes.select("id", "lon", "lat"), "id")
    w = W.partitionBy(*key).orderBy("pos")
    ahead = at.select(*key, F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    return ahead.where("lon2 IS NOT NULL")


def membership(points: DataFrame, edges: DataFrame, buffer_m: float = BUFFER_M, holes: bool = False) -> DataFrame:
    """(id, core, near): components that a point is inside of, and others that it is within ``buffer_m`` of, in order.

    A point is inside a component if it is in one of its outer rings and, with ``holes``, in none of its inner ones.
    """
    key = F.struct("component", "kind", "ring")
    hit = places.inside(points, edges.withColumn("area", key)).select("id", "area.*")
    sides = hit.groupBy("id", "component").agg(F.max(F.col("kind") == "outer").alias("o"), F.max(F.col("kind") == "inner").alias("i"))
    core = sides.where(F.col("o") & ~(F.lit(holes) & F.col("i"))).select("id", "component")
    near = core.limit(0)
    if buffer_m > 0:
        asked = edges.where(F.lit(holes) | (F.col("kind") == "outer")).withColumn("area", F.col("component"))
        near = places.near_boundary(points, asked, buffer_m).select("id", F.col("area").alias("component")).join(core, ["id", "component"], "left_anti")
    both = core.withColumn("z", F.lit("core")).unionByName(near.withColumn("z", F.lit("near")))
    sets = both.groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(F.col("z") == z, F.col("component")))).alias(z) for z in ("core", "near")])
    none = F.array().cast("array<string>")
    return points.select("id").join(sets, "id", "left").select("id", F.coalesce("core", none).alias("core"), F.coalesce("near", none).alias("near"))


def segment_refs(core_a: Column, near_a: Column, core_b: Column, near_b: Column) -> tuple[Column, Column]:
    """Zone and components of a segment: ``core`` of those that both ends are inside of, else ``buffer`` of all that either touches, else ``outside``."""
    shared = F.array_intersect(core_a, core_b)
    every = F.array_union(F.array_union(core_a, near_a), F.array_union(core_b, near_b))
    zone = F.when(F.size(shared) > 0, "core").when(F.size(every) > 0, "buffer").otherwise("outside")
    return zone, F.array_sort(F.when(F.size(shared) > 0, shared).otherwise(every))


def plain_zone(zone_a: Column, zone_b: Column) -> Column:
    """Zone of a segment from its ends' zones alone: core if both are, outside if both are, else buffer."""
    return F.when((zone_a == "core") & (zone_b == "core"), "core").when((zone_a != "outside") | (zone_b != "outside"), "buffer").otherwise("outside")


def clipped(parts: DataFrame, nodes: DataFrame, edges: DataFrame, buffer_m: float = BUFFER_M, holes: bool = False, mode: str = ENDPOINT, fill: bool = True) -> DataFrame:
    """(way, pos, a, b, length_m, zone, keep, kept_zone, refs) of segments (way, pos, a, b) against boundary edges.

    ``zone`` is the segment's own. It is kept if an end (or with MIDPOINT its middle) is not outside, or always with ALL;
    with ``fill`` and ENDPOINT, so are those between the first and the last kept of the way. A kept segment outside counts
    as buffer, and takes the components of its nearest kept neighbours that have some.
    """
    n = nodes.select("id", "lon", "lat")
    end = lambda c: n.select(F.col("id").alias(c), F.col("lon").alias(f"lon_{c}"), F.col("lat").alias(f"lat_{c}"))
    placed = parts.join(end("a"), "a").join(end("b"), "b")
    placed = placed.withColumn("length_m", haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")))
    if mode == MIDPOINT:
        middle = placed.withColumn("id", F.struct("way", "pos"))
        at = membership(middle.select("id", ((F.col("lon_a") + F.col("lon_b")) / 2).alias("lon"), ((F.col("lat_a") + F.col("lat_b")) / 2).alias("lat")), edges, buffer_m, holes)
        out = middle.join(at, "id").withColumn("zone", F.when(F.size("core") > 0, "core").when(F.size("near") > 0, "buffer").otherwise("outside")).withColumn("refs", F.array_sort(F.array_union("core", "near")))
    else:
        used = parts.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        known = membership(n.join(used, "id"), edges, buffer_m, holes)
        side = lambda c: known.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"), F.col("near").alias(f"near_{c}"))
        zone, refs = segment_refs(F.col("core_a"), F.col("near_a"), F.col("core_b"), F.col("near_b"))
        out = placed.join(side("a"), "a").join(side("b"), "b").withColumns({"zone": zone, "refs": refs})
    whole, order = W.partitionBy("way"), W.partitionBy("way").orderBy("pos")
    out = out.withColumn("keep", (F.col("zone") != "outside") | F.lit(mode == ALL))
    if fill and mode == ENDPOINT:
        at = F.when(F.col("keep"), F.col("pos"))
        out = out.withColumn("keep", F.coalesce(F.col("pos").between(F.min(at).over(whole), F.max(at).over(whole)), F.lit(False)))
    given = F.when(F.col("keep") & (F.size("refs") > 0), F.col("refs"))
    none = F.array().cast("array<string>")
    left = F.coalesce(F.last(given, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), none)
    right = F.coalesce(F.first(given, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)), none)
    out = out.withColumn("around", F.array_sort(F.array_union(left, right)))
    return out.select("way", "pos", "a", "b", "length_m", "zone", "keep", F.when(F.col("keep"), F.when(F.col("zone") == "outside", "buffer").otherwise(F.col("zone"))).alias("kept_zone"), F.when(F.size("refs") > 0, F.col("refs")).otherwise(F.when(F.col("keep"), F.col("around")).otherwise(none)).alias("refs"))


def way_records(cut: DataFrame, kept_only: bool = True) -> DataFrame:
    """(way, total_m, inside_m, buffer_m, segments) of ways with a kept segment, from the rows of ``clipped``.

    Lengths by zone are those of the kept segments, as kept; or, as when ways are computed again, of all by their own zone.
    """
    zone = F.col("kept_zone" if kept_only else "zone")
    part = lambda z: F.coalesce(F.sum(F.when(zone == z, F.col("length_m"))), F.lit(0.0))
    pairs = F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("pos", "a", "b", F.col("kept_zone").alias("zone"), F.array_join("refs", ",").alias("refs")))))
    return cut.groupBy("way").agg(F.sum("length_m").alias("total_m"), part("core").alias("inside_m"), part("buffer").alias("buffer_m"), pairs.alias("segments")).where(F.size("segments") > 0)
