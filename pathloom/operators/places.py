"""Points against areas and other points."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import crosses, haversine, map_x, map_y, segment_distance


#: Degrees of latitude in which points and ring edges meet.
BAND = 0.001


def inside(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(id, area) of points inside an area, by crossing parity over its ring edges (area, lon1, lat1, lon2, lat2).

    Edges and points meet in bands of latitude BAND degrees high, so this is an equi-join; a level edge crosses no ray.
    """
    hit = crosses(F.col("lon"), F.col("lat"), F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    at = lambda c: F.floor(c / BAND)
    banded = rings.withColumn("_band", F.explode(F.sequence(at(F.least("lat1", "lat2")), at(F.greatest("lat1", "lat2")))))
    return points.withColumn("_band", at(F.col("lat"))).join(banded, "_band").where(hit).groupBy("id", "area").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id", "area")


def near_boundary(points: DataFrame, rings: DataFrame, within_m: float) -> DataFrame:
    """(id, area, distance_m) of points at most ``within_m`` map metres from a ring edge. Edges and points meet in grid cells of that size."""
    p = points.select("id", map_x(F.col("lon")).alias("px"), map_y(F.col("lat")).alias("py"))
    e = rings.select("area", map_x(F.col("lon1")).alias("ax"), map_y(F.col("lat1")).alias("ay"), map_x(F.col("lon2")).alias("bx"), map_y(F.col("lat2")).alias("by"))
    cell = 20 * within_m
    at = lambda c: F.floor(c / cell)
    span = lambda a, b: F.sequence(at(F.least(a, b) - within_m), at(F.greatest(a, b) + within_m))
    e = e.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"))))
    d = segment_distance(F.col("px"), F.col("py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = p.withColumn("cx", at(F.col("px"))).withColumn("cy", at(F.col("py"))).join(e, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= within_m)
    return met.groupBy("id", "area").agg(F.min("d").alias("distance_m"))


def nearest(points: DataFrame, nodes: DataFrame, cell: float = 0.02) -> DataFrame:
    """(id, node, distance_m): the nearest node of each point, ties to the lower node.

    Points at the same place are searched for once. Points meet the nodes of the 3 x 3 cells around them. Where the best is farther than the cells surely reach, the cells grow
    fourfold for those points, up to CELL degrees. What is left then, points far from all nodes, goes down through ever smaller
    cells that hold nodes, and keeps those that can still hold the nearest. Without nodes it has nulls.
    """
    spots = points.groupBy("lon", "lat").agg(F.min("id").alias("id")).checkpoint()
    found = _nearest(spots, nodes, cell)
    at = spots.join(found, "id").select("lon", "lat", "node", "distance_m")
    return points.select("id", "lon", "lat").distinct().join(at, ["lon", "lat"]).select("id", "node", "distance_m")


def _nearest(points: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """``nearest`` of points that all lie at different places."""
    left, found = points.select("id", "lon", "lat"), None
    while cell <= CELL:
        at = lambda c, cell=cell: F.floor(c / F.lit(cell))
        n = nodes.select(F.col("id").alias("node"), F.col("lon").alias("nlon"), F.col("lat").alias("nlat"), at(F.col("lon")).alias("cx"), at(F.col("lat")).alias("cy"))
        around = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))
        p = left.withColumn("cx", around(F.col("lon"))).withColumn("cy", around(F.col("lat")))
        d = haversine(F.col("lon"), F.col("lat"), F.col("nlon"), F.col("nlat"))
        best = p.join(n, ["cx", "cy"], "left").groupBy("id", "lon", "lat").agg(F.min(F.when(F.col("node").isNotNull(), F.struct(d.alias("d"), F.col("node").alias("node")))).alias("m")).checkpoint()
        # A cell's width in metres at this latitude, less a little, is how far the ring of cells surely reaches.
        sure = F.col("m.d") <= F.lit(0.99 * cell) * F.radians(F.lit(1.0)) * 6371000.0 * F.cos(F.radians(F.abs("lat") + cell))
        done = best.where(F.coalesce(sure, F.lit(False))).select("id", F.col("m.node").alias("node"), F.col("m.d").alias("distance_m"))
        found = done if found is None else found.unionByName(done)
        left = best.where(~F.coalesce(sure, F.lit(False))).select("id", "lon", "lat")
        cell *= 4
        if left.isEmpty():
            return found
    far = _far(left, nodes)
    return far if found is None else found.unionByName(far)


#: Degrees of a cell up to which points meet all nodes around them; cells that far points go down through: the largest, and how often it is halved.
CELL, LARGEST, HALVINGS = 0.5, 22.5, 10


def _far(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node, distance_m) of points far from all nodes: cells are held against each other by the least and greatest distance that their nearest node can have."""
    least = LARGEST / 2**HALVINGS
    leaf = nodes.select(F.col("id").alias("node"), F.col("lon").alias("nlon"), F.col("lat").alias("nlat"), F.floor(F.col("lon") / least).alias("cx"), F.floor(F.col("lat") / least).alias("cy"))
    # Of each cell that holds nodes, one of them: how far it is bounds how far the nearest is.
    cells = leaf.groupBy("cx", "cy").agg(F.min(F.struct("node", "nlon", "nlat")).alias("one")).checkpoint()
    up = lambda c, k: F.floor(F.col(c) / F.lit(2**k)).alias(c)
    level = lambda k: cells.select(up("cx", k), up("cy", k), "one").groupBy("cx", "cy").agg(F.min("one").alias("one"))
    # At most 16 x 8 cells of the largest size cover the earth.
    top = [(r.cx, r.cy, r.one.nlon, r.one.nlat) for r in level(HALVINGS).collect()]
    all_ = F.array(*[F.struct(F.lit(x).alias("cx"), F.lit(y).alias("cy"), F.lit(u).alias("u"), F.lit(v).alias("v")) for x, y, u, v in top]) if top else None
    none = points.select("id", F.lit(None).cast(dict(nodes.dtypes)["id"]).alias("node"), F.lit(None).cast("double").alias("distance_m"))
    if all_ is None:
        return none
    pairs = points.select("id", "lon", "lat", F.explode(all_).alias("c")).select("id", "lon", "lat", "c.*")
    for k in range(HALVINGS, -1, -1):
        size = LARGEST * 2.0 ** (k - HALVINGS)
        if k < HALVINGS:
            child = level(k).select("cx", "cy", F.col("one.nlon").alias("u"), F.col("one.nlat").alias("v"), F.floor(F.col("cx") / 2).alias("px"), F.floor(F.col("cy") / 2).alias("py"))
            pairs = pairs.select("id", "lon", "lat", F.col("cx").alias("px"), F.col("cy").alias("py")).join(child, ["px", "py"]).drop("px", "py")
        west, south = F.col("cx") * size, F.col("cy") * size
        gap = F.radians(F.greatest(F.lit(0.0), south - F.col("lat"), F.col("lat") - south - size))
        aside = lambda x: F.least(F.abs(F.col("lon") - x), 360.0 - F.abs(F.col("lon") - x))
        inside = (F.col("lon") >= west) & (F.col("lon") <= west + size)
        near, wide = F.least(aside(west), aside(west + size)), F.greatest(aside(west), aside(west + size))
        over = F.when(inside | (wide > 90.0), 0.0).otherwise(F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(near))))
        low = 6371000.0 * F.greatest(gap, over) * 0.999999
        high = F.min(haversine(F.col("lon"), F.col("lat"), F.col("u"), F.col("v"))).over(W.partitionBy("id", "lon", "lat"))
        pairs = pairs.withColumns({"_low": low, "_high": high}).where("_low <= _high").select("id", "lon", "lat", "cx", "cy").checkpoint()
    d = haversine(F.col("lon"), F.col("lat"), F.col("nlon"), F.col("nlat"))
    met = pairs.join(leaf, ["cx", "cy"]).groupBy("id").agg(F.min(F.struct(d.alias("d"), F.col("node").alias("node"))).alias("m"))
    return met.select("id", F.col("m.node").alias("node"), F.col("m.d").alias("distance_m"))


def missing(rows: DataFrame, key: str, known: DataFrame, other: str) -> DataFrame:
    """Rows whose key must be in ``known`` and is not; empty means that the join may be an inner one."""
    return rows.join(known.select(F.col(other).alias(key)), key, "left_anti")


def zones(points: DataFrame, rings: DataFrame, buffer_m: float) -> DataFrame:
    """(id, zone, areas): ``core`` inside an area, ``buffer`` within ``buffer_m`` of one, else ``outside``; areas in order, joined by a semicolon."""
    core = inside(points, rings).select("id", "area", F.lit(0).alias("z"))
    near = near_boundary(points, rings, buffer_m).select("id", "area", F.lit(1).alias("z"))
    hit = core.unionByName(near).groupBy("id").agg(F.min("z").alias("z"), F.collect_set(F.struct("z", "area")).alias("s"))
    names = F.array_join(F.transform(F.array_sort(F.filter("s", lambda x: x["z"] == F.col("z"))), lambda x: x["area"].cast("string")), ";")
    hit = hit.select("id", "z", names.alias("areas"))
    zone = F.when(F.col("z") == 0, "core").when(F.col("z") == 1, "buffer").otherwise("outside")
    return points.select("id").join(hit, "id", "left").select("id", zone.alias("zone"), F.coalesce("areas", F.lit("")).alias("areas"))


def bound_junctions(points: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, node, distance_m, incident) of each junction: its nearest node at which a contig ends, or of all nodes if none does, and those contigs in order.

    ``ends`` is (node, contig).
    """
    routable = nodes.join(ends.select(F.col("node").alias("id")).distinct(), "id", "left_semi").checkpoint()
    bound = nearest(points, nodes if routable.isEmpty() else routable)
    bound = bound.checkpoint()
    at = ends.join(bound.select("node"), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("contig")).alias("incident"))
    return bound.join(at, "node", "left").select("id", "node", "distance_m", "incident")


#: Pairs that one group of ``all_pairs`` makes, about, and into how many partitions its groups are dealt at most.
PAIRS, PARTS = 4_000_000, 2000


def all_pairs(rows: DataFrame, by: str, key: str) -> DataFrame:
    """(by, key, to) of every ordered pair of keys of the same ``by``, each with itself too. A large group is dealt to slices, so that its pairs are made by many tasks."""
    most, groups = rows.groupBy(by).count().agg(F.max("count"), F.count("*")).first()
    slices = max(1, -(-(most or 0) ** 2 // PAIRS))
    parts = max(1, min(PARTS, slices * groups))
    one = rows.select(by, key, F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("_slice")).repartition(parts, by, "_slice")
    two = rows.select(by, F.col(key).alias("to"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice")).repartition(parts, by, "_slice")
    return one.hint("merge").join(two, [by, "_slice"]).select(by, key, "to")


def touched(contigs: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, id) of contigs (id, refs) and areas (area, refs) that have a ref in common, each pair once. An area without refs is touched by all contigs, and not listed."""
    wanted = areas.select("area", F.explode("refs").alias("ref"))
    return contigs.select("id", F.explode("refs").alias("ref")).join(wanted, "ref").select("area", "id").distinct()
