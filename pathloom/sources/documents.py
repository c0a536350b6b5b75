"""JSON documents as tables. A document is one object in one file; its lists and keyed objects become rows."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_META = "meta struct<asset_id:string,asset_kind:string,graph_asset_id:string,route_policy_asset_id:string,junction_catalog_asset_id:string,patchset_id:string,areas:array<struct<id:string,name:string>>>"
_NODE = "struct<id:bigint,lat:double,lon:double,elevation_m:double,degree:int>"
_SELECTOR = "struct<way_ids:array<bigint>,node_ids:array<bigint>>"
_POLICY = "map<string,string>"
_CONTIG = "struct<id:bigint,endpoint_node_ids:array<bigint>,node_ids:array<bigint>,segment_pairs:array<array<bigint>>,segment_count:int,length_m:double,is_cycle:boolean,way_ids:array<bigint>,way_names:array<string>,highway_types:map<string,int>,tags:map<string,string>,bounds:array<double>>"
_PROPERTIES = "struct<contig_id:bigint,endpoint_node_ids:array<bigint>,node_ids:array<bigint>,length_m:double,segment_count:int,way_ids:array<bigint>,way_names:array<string>,tags:map<string,string>,elevations_m:array<double>>"
#: What each kind of document holds; fields that are not named are left out, those that are missing are null.
SCHEMAS = {
    "raw": "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,members:array<struct<type:string,ref:bigint,role:string>>,tags:map<string,string>>>",
    "map": f"{_META}, nodes map<string,{_NODE}>, ways map<string,struct<id:bigint,node_ids:array<bigint>,tags:map<string,string>,segment_pairs:array<array<bigint>>,segment_zones:array<string>,segment_refs:array<string>,total_length_m:double,inside_length_m:double,buffer_length_m:double,bounds:array<double>>>",
    "graph": f"{_META}, nodes map<string,{_NODE}>, crossings map<string,{_NODE}>, contigs array<{_CONTIG}>",
    "elevation": f"{_META}, nodes map<string,{_NODE}>",
    "geojson": f"type string, features array<struct<type:string,properties:{_PROPERTIES},geometry:struct<type:string,coordinates:array<array<double>>>>>",
    "policy": f"{_META}, rules array<struct<id:string,selector:{_SELECTOR},policy:{_POLICY}>>",
    "bindings": f"{_META}, bindings array<struct<rule_id:string,status:string,selector:{_SELECTOR},policy:{_POLICY},junction_id:string,graph_node_id:bigint,incident_contig_ids:array<bigint>,distance_m:double>>",
    "patchset": f"{_META}, patches array<struct<id:string,enabled:boolean,op:string,way_id:bigint,node_ids:array<bigint>,nodes:array<struct<id:bigint,lon:double,lat:double>>,tags:map<string,string>,`set`:map<string,string>,remove:array<string>,boundary_mode:string>>",
    "areas": f"{_META}, areas array<struct<id:string,name:string,boundary_components:array<struct<type:string,id:bigint>>>>",
    "junctions": f"{_META}, junctions array<struct<id:string,name:string,area_id:string,kind:string,location:struct<lat:double,lon:double>,notes:string,tags:array<string>>>",
    "viewport": "min_x double, min_y double, max_x double, max_y double, width int, height int",
}


def read(spark: SparkSession, path: str, kind: str, label: str | None = None) -> DataFrame:
    """The document at ``path`` as one row with the columns of SCHEMAS[kind]. Raises where it is missing or no JSON object."""
    label = label or kind
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        raise FileNotFoundError(f"{label} is missing: {path}") from e
    if texts.isEmpty() or not texts.where(~F.coalesce(F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")), F.lit(False))).isEmpty():
        raise ValueError(f"{label} must be a JSON object: {path}")
    return texts.select(F.from_json("value", SCHEMAS[kind]).alias("d")).select("d.*")


def _keyed(document: DataFrame, column: str) -> DataFrame:
    return document.select(F.explode(column).alias("key", "v")).select("v.*", F.col("key").cast("long").alias("_key")).withColumn("id", F.coalesce("_key", "id")).drop("_key")


def raw_elements(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, lon, lat), ways (way, nodes, tags) and relation members (relation, ord, ref, kind, tags) of a ``raw`` document."""
    e = document.select(F.explode("elements").alias("e")).select("e.*")
    none = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    nodes = e.where("type = 'node'").select("id", "lon", "lat")
    ways = e.where("type = 'way'").select(F.col("id").alias("way"), F.coalesce("nodes", F.array().cast("array<bigint>")).alias("nodes"), F.coalesce("tags", none).alias("tags"))
    members = e.where("type = 'relation'").select(F.col("id").alias("relation"), "tags", F.posexplode("members").alias("ord", "m")).where("m.type = 'way'").select("relation", "ord", F.col("m.ref").alias("ref"), F.col("m.role").alias("kind"), "tags")
    return nodes, ways, members


def normalized_map(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lon, lat) and segments (way, pos, a, b, zone, refs, tags) of a ``map`` document; zones default to core, refs to none."""
    w = _keyed(document, "ways")
    at = lambda name, default: F.coalesce(F.get(F.col(name), F.col("pos")), F.lit(default))
    parts = w.select(F.col("id").alias("way"), "tags", "segment_zones", "segment_refs", F.posexplode("segment_pairs").alias("pos", "p"))
    return _keyed(document, "nodes").select("id", "lon", "lat"), parts.select("way", F.col("pos").cast("long").alias("pos"), F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"), at("segment_zones", "core").alias("zone"), at("segment_refs", "").alias("refs"), "tags")


def contig_graph(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, lon, lat, degree: 0 where no contig ends), contigs, and arcs (at, to, contig, length_m, forward, is_cycle, tags) of a ``graph`` document.

    A contig gives an arc each way; one that ends where it begins gives one.
    """
    contigs = document.select(F.explode("contigs").alias("c")).select("c.*")
    a, b = (F.get("endpoint_node_ids", F.lit(k)) for k in (0, 1))
    there = contigs.select(a.alias("at"), b.alias("to"), F.col("id").alias("contig"), "length_m", F.lit(True).alias("forward"), "is_cycle", "tags")
    back = contigs.where(a != b).select(b.alias("at"), a.alias("to"), F.col("id").alias("contig"), "length_m", F.lit(False).alias("forward"), "is_cycle", "tags")
    arcs = there.unionByName(back)
    degree = arcs.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("degree"))
    nodes = _keyed(document, "nodes").select("id", "lon", "lat").join(degree, "id", "left")
    return nodes.withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))), contigs, arcs


def elevations(document: DataFrame, graph_asset_id: str | None = None) -> DataFrame:
    """(id, elevation_m) of the nodes that have one; none at all if the document belongs to another graph."""
    fits = F.lit(True) if graph_asset_id is None else F.col("meta.graph_asset_id") == graph_asset_id
    return _keyed(document.where(fits), "nodes").where("elevation_m IS NOT NULL").select("id", "elevation_m")


def features(document: DataFrame) -> DataFrame:
    """The features of a ``geojson`` document: their properties, and coordinates with six decimals."""
    f = document.select(F.posexplode("features").alias("ord", "f"))
    return f.select("ord", F.col("f.type").alias("type"), F.col("f.geometry.type").alias("shape"), "f.properties.*", F.transform("f.geometry.coordinates", lambda p: F.transform(p, lambda v: F.round(v, 6))).alias("coordinates"))


def feature_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lon, lat, elevation_m: the first known) and arcs (at, to, contig, length_m, forward, is_cycle, tags) of features."""
    points = found.select("ord", F.posexplode("node_ids").alias("pos", "id"), "coordinates", "elevations_m")
    place = F.struct("ord", "pos")
    at = points.select("id", place.alias("k"), F.get("coordinates", F.col("pos")).alias("c"), F.get("elevations_m", F.col("pos")).alias("e"))
    nodes = at.groupBy("id").agg(F.min_by("c", "k").alias("c"), F.min_by("e", F.when(F.col("e").isNotNull(), F.col("k"))).alias("elevation_m")).select("id", F.get("c", F.lit(0)).alias("lon"), F.get("c", F.lit(1)).alias("lat"), "elevation_m")
    a, b = (F.get("endpoint_node_ids", F.lit(k)) for k in (0, 1))
    side = lambda u, v, way: found.select(u.alias("at"), v.alias("to"), F.col("contig_id").alias("contig"), "length_m", F.lit(way).alias("forward"), (a == b).alias("is_cycle"), "tags", a.alias("_a"), b.alias("_b"))
    return nodes, side(a, b, True).unionByName(side(b, a, False).where("_a <> _b")).drop("_a", "_b")


def patches(document: DataFrame) -> DataFrame:
    """(ord, id, enabled, op, way, nodes, tags, set, remove, new_nodes, mode) of a ``patchset`` document; patches are enabled unless they say no."""
    p = document.select(F.posexplode("patches").alias("ord", "p")).select("ord", "p.*")
    return p.select("ord", "id", F.coalesce("enabled", F.lit(True)).alias("enabled"), "op", F.col("way_id").alias("way"), F.col("node_ids").alias("nodes"), "tags", "set", "remove", F.col("nodes").alias("new_nodes"), F.coalesce("boundary_mode", F.lit("inside_endpoint")).alias("mode"))


def rows(document: DataFrame, column: str) -> DataFrame:
    """The items of a list of a document, with their place as ``ord``."""
    return document.select(F.posexplode(column).alias("ord", "x")).select("ord", "x.*")


def selector_edges(rules: DataFrame) -> DataFrame:
    """(id, way_ids, pos, a, b) with a < b: the edges along each rule's selector."""
    n: Column = F.col("selector.node_ids")
    steps = F.zip_with(F.slice(n, 1, F.size(n) - 1), F.slice(n, 2, F.size(n) - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    return rules.where(F.size(n) > 1).select("id", F.col("selector.way_ids").alias("way_ids"), F.posexplode(steps).alias("pos", "e")).select("id", "way_ids", "pos", "e.*")
