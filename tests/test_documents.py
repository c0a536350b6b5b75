"""Documents read, checked and written."""
import json

import pytest
from pyspark.sql import functions as F

from pathloom.functions import policy, text
from pathloom.plans import validation
from pathloom.sinks import documents as sinks
from pathloom.sources import documents

META = {"asset_id": "g", "asset_kind": "k", "graph_asset_id": "graph-a", "patchset_id": "p", "route_policy_asset_id": "r", "junction_catalog_asset_id": "j"}


def put(tmp_path, kind, content):
    path = tmp_path / f"{kind}.json"
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
    return str(path)


def problems(df):
    return {tuple(r) for r in df.collect()}


def test_missing_and_odd_documents(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="the map is missing"):
        documents.read(spark, str(tmp_path / "none.json"), "map", "the map")
    for odd in ("[1]", "{", ""):
        with pytest.raises(ValueError, match="JSON object"):
            documents.read(spark, put(tmp_path, "odd", odd), "map")


def test_raw_elements(spark, tmp_path):
    raw = {"elements": [{"type": "node", "id": 1, "lat": 0.5, "lon": 2.0}, {"type": "way", "id": 7, "nodes": [1, 2], "tags": {"highway": "path"}}, {"type": "way", "id": 8}, {"type": "relation", "id": 9, "members": [{"type": "way", "ref": 7, "role": "outer"}, {"type": "node", "ref": 1, "role": "x"}]}]}
    nodes, ways, members = documents.raw_elements(documents.read(spark, put(tmp_path, "raw", raw), "raw"))
    assert [tuple(r) for r in nodes.collect()] == [(1, 2.0, 0.5)]
    assert {r.way: (r.nodes, r.tags) for r in ways.collect()} == {7: ([1, 2], {"highway": "path"}), 8: ([], {})}
    assert [(r.relation, r.ref, r.kind) for r in members.collect()] == [(9, 7, "outer")]


def test_map_defaults_and_array_lengths(spark, tmp_path):
    doc = {"meta": META, "nodes": {"1": {"id": 1, "lat": 0, "lon": 0}}, "ways": {"5": {"id": 5, "tags": {}, "segment_pairs": [[1, 2], [2, 3]]}, "6": {"id": 6, "tags": {}, "segment_pairs": [[1, 2]], "segment_zones": ["buffer", "core"], "segment_refs": ["r1"]}}}
    found = documents.read(spark, put(tmp_path, "map", doc), "map")
    nodes, parts = documents.normalized_map(found)
    assert nodes.count() == 1 and {(r.way, r.pos, r.a, r.b, r.zone, r.refs) for r in parts.collect()} == {(5, 0, 1, 2, "core", ""), (5, 1, 2, 3, "core", ""), (6, 0, 1, 2, "buffer", "r1")}
    assert problems(validation.segment_arrays(documents._keyed(found, "ways"))) == {("6", "segment_zones differ in length")}


def contig(k, a, b, **more):
    return {"id": k, "endpoint_node_ids": [a, b], "node_ids": [a, b], "segment_count": 1, "length_m": 5.0, "is_cycle": False, "way_ids": [1], "way_names": [], "tags": {}} | more


def test_graph_and_elevations(spark, tmp_path):
    nodes = {str(k): {"id": k, "lat": 0, "lon": k, "elevation_m": 7.5 if k < 3 else None} for k in range(1, 5)}
    doc = documents.read(spark, put(tmp_path, "graph", {"meta": META, "nodes": nodes, "crossings": {}, "contigs": [contig(1, 1, 2), contig(2, 3, 3), contig(3, 2, 3, endpoint_node_ids=[2])]}), "graph")
    n, contigs, arcs = documents.contig_graph(doc)
    assert {r.id: r.degree for r in documents.contig_graph(doc)[0].collect()}[4] == 0 and arcs.where("contig = 2").count() == 1 and arcs.where("contig = 1").count() == 2
    assert problems(validation.graph(doc, n, contigs)) == {("3", "endpoint_node_ids must be two integers")}
    assert {r.id for r in documents.elevations(doc, "graph-a").collect()} == {1, 2} and documents.elevations(doc, "graph-b").count() == 0
    assert problems(validation.elevation(doc)) == set()


def test_features(spark, tmp_path):
    def one(k, nodes, points, **more):
        return {"type": "Feature", "properties": {"contig_id": k, "endpoint_node_ids": [nodes[0], nodes[-1]], "node_ids": nodes, "length_m": 1.0, "segment_count": 1, "way_ids": [1], "way_names": [], "tags": {}} | more, "geometry": {"type": "LineString", "coordinates": points}}

    good = [one(1, [1, 2], [[36.12345678, -1], [36.2, -1]]), one(2, [2, 3], [[36.2, -1], [36.3, -1]], elevations_m=[5.0, 6.0])]
    found = documents.features(documents.read(spark, put(tmp_path, "good", {"type": "FeatureCollection", "features": good}), "geojson"))
    assert problems(validation.features(found)) == set()
    nodes, arcs = documents.feature_graph(found)
    assert {r.id: (r.lon, r.elevation_m) for r in nodes.collect()} == {1: (36.123457, None), 2: (36.2, 5.0), 3: (36.3, 6.0)} and arcs.count() == 4
    bad = [*good, one(2, [3, 4, 5], [[1, 1], [2, 2]], elevations_m=[1.0]), one(4, [3, 4], [[1, 1], [2, 2]], endpoint_node_ids=[4, 3])]
    found = documents.features(documents.read(spark, put(tmp_path, "bad", {"type": "FeatureCollection", "features": bad}), "geojson"))
    assert problems(validation.features(found)) == {("2", "node_ids and coordinates differ in length"), ("2", "elevations_m and node_ids differ in length"), ("2", "duplicate contig id"), ("3", "ends must be the first and last node")}


def test_policies_and_patches(spark, tmp_path):
    fine = {"routing_state": "include", "bikeability": 5, "unavailable_until": "2026-05-01"}
    rules = [{"id": "a", "selector": {"way_ids": [3], "node_ids": [12, 11, 10]}, "policy": fine}, {"id": "", "selector": {"way_ids": [], "node_ids": [1]}, "policy": {}}, {"id": "c", "selector": {"way_ids": [1], "node_ids": [1, 2]}, "policy": {"routing_state": "maybe", "bikeability": 6, "bicycle_direction": "up", "unavailable_until": "2026-5-1", "colour": "red"}}]
    doc = documents.read(spark, put(tmp_path, "policy", {"meta": META, "rules": rules}), "policy")
    found = documents.rows(doc, "rules")
    out = problems(validation.rules(doc, found))
    assert {p for k, p in out if k == "1"} == {"id must be a non-empty string", "way_ids must have an id", "node_ids must have two ids", "policy must have a field"} and len([k for k, _ in out if k == "2"]) == 5 and not [k for k, _ in out if k == "0"]
    with pytest.raises(ValueError, match="the policy: 1: id must be"):
        validation.ensure(validation.rules(doc, found), "the policy")
    assert [(r.pos, r.a, r.b) for r in documents.selector_edges(found.where("id = 'a'")).collect()] == [(0, 11, 12), (1, 10, 11)]
    patch = documents.read(spark, put(tmp_path, "patches", {"meta": {"asset_kind": "k"}, "patches": [{"id": "x", "op": "remove_way", "way_id": 4}]}), "patchset")
    assert problems(validation.patchset(patch)) == {("meta", "patchset_id must be a non-empty string")} and documents.patches(patch).first().enabled


def test_areas_and_junctions(spark, tmp_path):
    areas = [{"id": "n", "name": "North", "boundary_components": [{"type": "relation", "id": 1}]}, {"id": "n", "name": "", "boundary_components": [{"type": "relation", "id": 1}, {"type": "node", "id": 2}]}, {"id": "s", "name": "South", "boundary_components": []}]
    doc = documents.read(spark, put(tmp_path, "areas", {"meta": META, "areas": areas}), "areas")
    assert problems(validation.areas(doc, documents.rows(doc, "areas"))) == {("n", "duplicate area id"), ("r1", "duplicate boundary component"), ("1", "name must be a non-empty string"), ("1", "component type must be relation or way"), ("2", "boundary_components must not be empty")}
    points = [{"id": "a", "name": "A", "area_id": "n", "location": {"lat": 1, "lon": 2}}, {"id": "b", "name": "B", "area_id": "x", "location": {"lat": 1}}]
    for named, lost in (([{"id": "n", "name": "North"}], {("1", "area is not known")}), ([], set())):
        doc = documents.read(spark, put(tmp_path, f"j{len(named)}", {"meta": META | {"areas": named}, "junctions": points}), "junctions")
        assert problems(validation.junctions(doc, documents.rows(doc, "junctions"))) == {("1", "location must have numbers")} | lost
    pairs = spark.createDataFrame([("a__to__z", "a", "z")], "id string, start_id string, end_id string")
    assert problems(validation.scenarios(pairs, spark.createDataFrame([("a",)], "id string"))) == {("a__to__z", "junction is not known")}


def test_tag_rules(spark):
    cases = [({}, False), ({"highway": "path"}, True), ({"amenity": "parking"}, True), ({"highway": "x", "local:boundary_zone": "buffer"}, False), ({"local:boundary_zone": "buffer", "local:routing_state": "include"}, True), ({"highway": "x", "local:routing_state": "exclude"}, False),
             ({"highway": "x", "local:unavailable_until": "2026-05-01"}, False), ({"highway": "x", "local:unavailable_until": "2026-5-01"}, True), ({"local:routing_state": "include", "local:availability": "temporarily_unavailable"}, False), ({"highway": "x", "local:context_only": "yes"}, False)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "id int, tags map<string,string>")
    on = F.lit("2026-05-01").cast("date")
    assert {r.id: r.x for r in df.select("id", policy.rideable(F.col("tags"), on).alias("x")).collect()} == {k: x for k, (_, x) in enumerate(cases)}
    ways = df.where("id = 1").select(*[policy.traversable(F.create_map(F.lit("local:bicycle_direction"), F.lit(d)), on, F.lit(c), F.lit(f)).alias(f"{d}{c}{f}") for d in ("forward", "backward") for c in (False, True) for f in (False, True)]).first().asDict()
    assert {k for k, v in ways.items() if not v} == {"forwardFalseFalse", "backwardFalseTrue"}


def test_texts(spark):
    row = spark.range(1).select(text.fnv1a(F.lit("")).alias("a"), text.fnv1a(F.lit("a")).alias("b"), text.fnv1a(F.lit("foobar")).alias("c"), text.xml_escape(F.lit("<a & 'b'>")).alias("d"), *[x.alias(f"p{k}") for k, x in enumerate(text.pixel(F.lit(5.0), F.lit(2.0), (0, 0, 10, 10), 100, 50))]).first()
    assert (row.a, row.b, row.c, row.d, row.p0, row.p1) == ("811c9dc5", "e40c292c", "bf9cf968", "&lt;a &amp; &apos;b&apos;&gt;", 50.0, 40.0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "r<1>", [[36.5, -1.25], [36.1234567, -1.0]], [1600.04, 1601.0], ["r1"]), (2, "r2", [[36.0, -1.0]], None, ["w2"])], "k long, id string, points array<array<double>>, high array<double>, refs array<string>")
    out = {r.k: r.g for r in df.select("k", sinks.gpx(F.col("id"), F.concat(F.col("id"), F.lit(" to & from")), F.col("points"), F.col("high")).alias("g")).collect()}
    assert "<name>r&lt;1&gt; to &amp; from</name>" in out[1] and '<trkpt lat="-1.25" lon="36.5">\n        <ele>1600.0</ele>' in out[1] and '<trkpt lat="-1" lon="36"></trkpt>' in out[2]
    made = df.withColumn("feature", sinks.feature(F.col("k"), F.col("points"), {"name": F.col("id")}, F.col("high")))
    first = json.loads(made.where("k = 1").first().feature)
    assert first["geometry"]["coordinates"][1] == [36.123457, -1.0] and first["properties"] == {"contig_id": 1, "name": "r<1>", "elevations_m": [1600.0, 1601.0]}
    areas = spark.createDataFrame([("all", []), ("one", ["r1", "r9"])], "area string, refs array<string>")
    sinks.write_by_area(made, areas, f"{tmp_path}/areas")
    assert spark.read.text(f"{tmp_path}/areas").groupBy("area").count().orderBy("area").collect()[1]["count"] == 1
    with pytest.raises(ValueError, match="area lost"):
        sinks.write_by_area(made, spark.createDataFrame([("lost", ["x"])], areas.schema), f"{tmp_path}/none")
    sinks.write_collection(made, f"{tmp_path}/all", "k")
    sinks.write_json(df.select("k", "id"), f"{tmp_path}/json", True)
    assert spark.read.text(f"{tmp_path}/all").count() == 2 and spark.read.text(f"{tmp_path}/json").first()[0] == '{"id":"r<1>","k":1}'
    assert sinks.markdown(df.select("k", F.lit(1.5).alias("x")).orderBy("k"), ["k", "x"]).splitlines()[2] == "| 1 | 1.50 |"
    old = df.select("k", "id", F.lit("then").alias("at"))
    assert sinks.differences(df.select("k", "id", F.lit("now").alias("at")), old, ("at",)).count() == 0 and sinks.differences(df.select("k", "id"), old.where("k = 1").select("k", "id")).first().side == "made"
