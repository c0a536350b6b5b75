"""What is wrong with documents: each check gives rows (label, problem), and a document is valid if there are none."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import FIELDS, iso_date


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def broken(rows: DataFrame, label: Column, rules: dict[str, Column]) -> DataFrame:
    """(label, problem) of each rule that holds for a row; a rule that is null does not."""
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(label.alias("label"), F.explode(found).alias("problem"))


def repeated(rows: DataFrame, key: str, problem: str) -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias("label")).agg(F.count("*").alias("n")).where("n > 1").select("label", F.lit(problem).alias("problem"))


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def ensure(problems: DataFrame, name: str) -> None:
    """Raise with the first problem, if there is one."""
    first = problems.orderBy("label", "problem").first()
    if first is not None:
        raise ValueError(f"{name}: {first.label}: {first.problem}")


def meta(document: DataFrame, fields: tuple[str, ...] = ("asset_id", "asset_kind")) -> DataFrame:
    return broken(document, F.lit("meta"), {f"{f} must be a non-empty string": blank(F.col(f"meta.{f}")) for f in fields})


def policy_problems(policy: Column) -> dict[str, Column]:
    """A policy is a map of field names to texts: at least one field, known ones only, each in its domain."""
    state, grade, direction, until = (policy[f] for f in FIELDS)
    return {
        "policy must have a field": policy.isNull() | (F.size(policy) < 1), "policy has an unsupported field": F.exists(F.map_keys(policy), lambda k: ~k.isin(*FIELDS)),
        "routing_state must be include or exclude": ~state.isin("include", "exclude"), "bikeability must be an integer from 1 to 5": grade.isNotNull() & ~F.coalesce(grade.isin(*"12345"), F.lit(False)),
        "bicycle_direction must be forward or backward": ~direction.isin("forward", "backward"), "unavailable_until must be a date": until.isNotNull() & iso_date(until).isNull()}


def selector_problems(selector: Column) -> dict[str, Column]:
    return {"way_ids must have an id": F.coalesce(F.size(selector["way_ids"]), F.lit(0)) < 1, "node_ids must have two ids": F.coalesce(F.size(selector["node_ids"]), F.lit(0)) < 2}


def rules(document: DataFrame, found: DataFrame) -> DataFrame:
    """Of a route policy: its meta, ids, selectors and policies."""
    return together(meta(document), broken(found, F.col("ord").cast("string"), {"id must be a non-empty string": blank(F.col("id"))} | selector_problems(F.col("selector")) | policy_problems(F.col("policy"))))


def rule_bindings(document: DataFrame, found: DataFrame) -> DataFrame:
    own = {"rule_id must be a non-empty string": blank(F.col("rule_id")), "status is not known": ~F.coalesce(F.col("status").isin("exact", "reversed", "split_across_contigs"), F.lit(False))}
    return together(meta(document, ("asset_id", "asset_kind", "graph_asset_id", "route_policy_asset_id")), broken(found, F.col("ord").cast("string"), own | selector_problems(F.col("selector")) | policy_problems(F.col("policy"))))


def junction_bindings(document: DataFrame, found: DataFrame) -> DataFrame:
    own = {"junction_id must be a non-empty string": blank(F.col("junction_id")), "graph_node_id must be an integer": F.col("graph_node_id").isNull(), "distance_m must be numeric": F.col("distance_m").isNull(),
           "incident_contig_ids must be integers": F.col("incident_contig_ids").isNull() | F.exists("incident_contig_ids", lambda x: x.isNull())}
    return together(meta(document, ("asset_id", "asset_kind", "graph_asset_id", "junction_catalog_asset_id")), broken(found, F.col("ord").cast("string"), own))


def patchset(document: DataFrame) -> DataFrame:
    return together(meta(document, ("asset_kind", "patchset_id")), broken(document, F.lit("patches"), {"patches must be an array": F.col("patches").isNull()}))


def areas(document: DataFrame, found: DataFrame) -> DataFrame:
    """Ids are unique, and so are boundary components, over all areas."""
    parts = found.select("ord", F.explode("boundary_components").alias("c")).select("ord", "c.*")
    refs = parts.select(F.concat(F.when(F.col("type") == "relation", "r").otherwise("w"), F.col("id").cast("string")).alias("ref"))
    return together(
        meta(document), repeated(found, "id", "duplicate area id"), repeated(refs.where("ref IS NOT NULL"), "ref", "duplicate boundary component"),
        broken(found, F.col("ord").cast("string"), {"id must be a non-empty string": blank(F.col("id")), "name must be a non-empty string": blank(F.col("name")), "boundary_components must not be empty": F.coalesce(F.size("boundary_components"), F.lit(0)) < 1}),
        broken(parts, F.col("ord").cast("string"), {"component type must be relation or way": ~F.coalesce(F.col("type").isin("relation", "way"), F.lit(False)), "component id must be an integer": F.col("id").isNull()}))


def junctions(document: DataFrame, found: DataFrame) -> DataFrame:
    """Where the meta data name areas, junctions may only be in those."""
    named = document.select(F.explode("meta.areas").alias("a")).select("a.*")
    own = {"id must be a non-empty string": blank(F.col("id")), "name must be a non-empty string": blank(F.col("name")), "area_id must not be empty": F.col("area_id") == "", "location must have numbers": F.col("location.lat").isNull() | F.col("location.lon").isNull()}
    lost = found.where("area_id IS NOT NULL").join(named.select(F.col("id").alias("area_id")), "area_id", "left_anti").join(named.agg(F.count("*").alias("n")), F.col("n") > 0, "left_semi")
    return together(meta(document), repeated(named, "id", "duplicate area id"), broken(found, F.col("ord").cast("string"), own), lost.select(F.col("ord").cast("string").alias("label"), F.lit("area is not known").alias("problem")))


def elevation(document: DataFrame) -> DataFrame:
    return together(meta(document, ("graph_asset_id",)), broken(document, F.lit("nodes"), {"nodes must be an object": F.col("nodes").isNull()}))


def graph(document: DataFrame, nodes: DataFrame, contigs: DataFrame) -> DataFrame:
    ends = F.col("endpoint_node_ids")
    own = {"endpoint_node_ids must be two integers": ends.isNull() | (F.size(ends) != 2) | F.exists(ends, lambda x: x.isNull()), "node_ids must be integers": F.coalesce(F.size("node_ids"), F.lit(0)) < 2, "length_m must be numeric": F.col("length_m").isNull(), "tags must be an object": F.col("tags").isNull()}
    return together(meta(document), broken(nodes, F.col("id").cast("string"), {"lat and lon must be numeric": F.col("lat").isNull() | F.col("lon").isNull()}), broken(contigs, F.col("id").cast("string"), own | {"id must be an integer": F.col("id").isNull()}))


def features(found: DataFrame) -> DataFrame:
    """Of map features: shape, lengths that agree, ends that match, and contig ids that are unique."""
    n, ends = F.col("node_ids"), F.col("endpoint_node_ids")
    own = {
        "type must be Feature": ~F.coalesce(F.col("type") == "Feature", F.lit(False)), "shape must be LineString": ~F.coalesce(F.col("shape") == "LineString", F.lit(False)), "at least two points": F.coalesce(F.size("coordinates"), F.lit(0)) < 2,
        "node_ids and coordinates differ in length": F.size(n) != F.size("coordinates"), "exactly two ends": F.coalesce(F.size(ends), F.lit(0)) != 2, "ends must be the first and last node": (F.get(ends, F.lit(0)) != F.get(n, F.lit(0))) | (F.get(ends, F.lit(1)) != F.try_element_at(n, F.lit(-1))),
        "elevations_m and node_ids differ in length": F.size("elevations_m") != F.size(n), "elevations_m must be numbers": F.exists("elevations_m", lambda x: x.isNull() | F.isnan(x)), "contig_id must be an integer": F.col("contig_id").isNull(), "tags must be an object": F.col("tags").isNull()}
    return together(broken(found, F.col("ord").cast("string"), own), repeated(found, "contig_id", "duplicate contig id"))


def segment_arrays(ways: DataFrame) -> DataFrame:
    """Zones and refs of a way, where it has them, are as many as its segments."""
    n = F.size("segment_pairs")
    return broken(ways, F.col("id").cast("string"), {"segment_zones differ in length": F.size("segment_zones") != n, "segment_refs differ in length": F.size("segment_refs") != n})


def scenarios(found: DataFrame, known: DataFrame) -> DataFrame:
    """Scenarios (id, start_id, end_id) whose ends are no junctions (id)."""
    ends = found.select(F.col("id").alias("label"), F.explode(F.array("start_id", "end_id")).alias("id"))
    return ends.join(known.select("id"), "id", "left_anti").select("label", F.lit("junction is not known").alias("problem")).distinct()
