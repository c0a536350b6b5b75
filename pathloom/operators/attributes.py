"""What edges and contigs carry: names, kinds of way with their counts, zones, refs, policy, bounds. Counts are maps that add up."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.policy import REFS_TAG, ZONE_TAG, policy_tags


def _counts(rows: DataFrame, key: list[str], kind: str, n: Column, name: str) -> DataFrame:
    """(key, name): how often each kind occurs, as a map in the order of the kinds."""
    one = rows.where(F.coalesce(F.col(kind), F.lit("")) != "").groupBy(*key, kind).agg(F.sum(n).alias("_n"))
    return one.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_n")))).alias(name))


def _empty(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column), F.map_from_arrays(F.array(), F.array()).cast(kind)).alias(column)


def edge_conflicts(parts: DataFrame) -> DataFrame:
    """(a, b, problem) of edges whose segments (a, b, zone, tags, ...) disagree on the zone or on a policy tag."""
    keyed = parts.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    zones = keyed.groupBy("a", "b").agg(F.count_distinct("zone").alias("n")).where("n > 1").select("a", "b", F.lit("conflicting boundary zones").alias("problem"))
    values = keyed.select("a", "b", F.explode(policy_tags(F.col("tags"))).alias("key", "value")).groupBy("a", "b", "key").agg(F.count_distinct("value").alias("n"))
    return zones.unionByName(values.where("n > 1").select("a", "b", F.concat(F.lit("conflicting "), "key").alias("problem")))


def edges(parts: DataFrame, nodes: DataFrame, checkpoint=lambda df: df) -> DataFrame:
    """(a, b, length_m, ways, way_names, highway_types, tags) of undirected edges from segments (way, a, b, zone, refs, tags) and nodes (id, lon, lat).

    Segments with an unknown end are left out, each other one counts its kind of way once. ``tags`` holds the zone, the union of all refs in order,
    and the policy of the segments. Where segments disagree it raises, with the first such edge.
    ``checkpoint`` can store the segments with their ends, which are read for the disagreements, the sets and the counts.
    """
    at = nodes.select("id", "lon", "lat")
    keyed = parts.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    keyed = keyed.join(at.withColumnsRenamed({"id": "a", "lon": "lon1", "lat": "lat1"}), "a").join(at.withColumnsRenamed({"id": "b", "lon": "lon2", "lat": "lat2"}), "b")
    keyed = checkpoint(keyed)
    first = edge_conflicts(keyed).orderBy("a", "b", "problem").first()
    if first is not None:
        raise ValueError(f"edge {first.a}-{first.b}: {first.problem}")
    named = keyed.withColumns({"_kind": F.col("tags")["highway"], "_name": F.when(F.col("tags")["name"] != "", F.col("tags")["name"]), "_policy": F.map_entries(policy_tags(F.col("tags")))})
    one = named.groupBy("a", "b").agg(
        F.first(haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))).alias("length_m"), F.array_sort(F.collect_set("way")).alias("ways"), F.array_sort(F.collect_set("_name")).alias("way_names"),
        F.first("zone").alias("_zone"), F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set(F.split("refs", ",")))), lambda r: r != "")).alias("_refs"), F.array_distinct(F.flatten(F.collect_set("_policy"))).alias("_policy"))
    refs = F.when(F.size("_refs") > 0, F.array(F.struct(F.lit(REFS_TAG).alias("key"), F.array_join("_refs", ",").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    tags = F.map_from_entries(F.array_sort(F.concat(F.array(F.struct(F.lit(ZONE_TAG).alias("key"), F.col("_zone").alias("value"))), refs, "_policy")))
    kinds = _counts(named, ["a", "b"], "_kind", F.lit(1), "highway_types")
    return one.withColumn("tags", tags).join(kinds, ["a", "b"], "left").select("a", "b", "length_m", "ways", "way_names", _empty("highway_types", "map<string,bigint>"), "tags")


def contigs(steps: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(contig, node_ids, segments, length_m, is_cycle, way_ids, way_names, highway_types, tags, bounds) from the rows of ``contigs.ordered`` and ``edges``.

    Lengths are summed and rounded to millimetres, sets united, counts added; ``bounds`` (least and greatest lon and lat, to 7 places) are those of all its nodes. The edges of a
    contig have the same tags, as crossings are where they differ; else it raises.
    """
    known = steps.join(found, (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b")))
    entries = F.array_sort(F.map_entries("tags"))
    uneven = known.groupBy("contig").agg(F.count_distinct(entries).alias("n")).where("n > 1").orderBy("contig").first()
    if uneven is not None:
        raise ValueError(f"contig {uneven.contig}: edges of different tags")
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    whole = known.groupBy("contig", "is_cycle").agg(
        F.array_sort(F.collect_list(F.struct("pos", "u", "v"))).alias("s"), F.count("*").alias("segments"), F.round(F.sum("length_m"), 3).alias("length_m"), united("ways"), united("way_names"), F.first(entries).alias("tags"))
    kinds = _counts(known.select("contig", F.explode("highway_types").alias("_kind", "_m")), ["contig"], "_kind", F.col("_m"), "highway_types")
    ends = steps.select("contig", F.explode(F.array("u", "v")).alias("id")).join(nodes.select("id", "lon", "lat"), "id").groupBy("contig")
    box = ends.agg(F.array(*(F.round(f(c), 7) for f in (F.min, F.max) for c in ("lon", "lat"))).alias("bounds"))
    out = whole.join(kinds, "contig", "left").join(box, "contig")
    path = F.concat(F.array(F.col("s")[0]["u"]), F.transform("s", lambda x: x["v"])).alias("node_ids")
    return out.select("contig", path, "segments", "length_m", "is_cycle", F.col("ways").alias("way_ids"), "way_names", _empty("highway_types", "map<string,bigint>"), F.map_from_entries("tags").alias("tags"), "bounds")
