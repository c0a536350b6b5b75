"""Attributes of edges and contigs on a small network, with conflicts."""
import pytest

from pathloom.functions.policy import POLICY_TAGS, REFS_TAG, ZONE_TAG
from pathloom.operators import attributes

STATE = POLICY_TAGS["routing_state"]
COLUMNS = "way long, a long, b long, zone string, refs string, tags map<string,string>"
PARTS = [(7, 1, 2, "core", "r2", {"highway": "path", "name": "East"}), (8, 2, 1, "core", "r1,r2", {"highway": "path", STATE: "include"}), (8, 1, 2, "core", "", {"highway": "track", "name": ""}), (9, 2, 3, "core", "r1,r2", {STATE: "include"}), (9, 3, 99, "core", "", {})]


def test_attributes(spark):
    nodes = spark.createDataFrame([(1, 36.0, -1.0), (2, 36.001, -1.0), (3, 36.001, -1.00123456789)], "id long, lon double, lat double")
    found = {(r.a, r.b): r for r in attributes.edges(spark.createDataFrame(PARTS, COLUMNS), nodes).collect()}
    e = found[1, 2]
    assert set(found) == {(1, 2), (2, 3)} and e.length_m == pytest.approx(111.178, abs=0.01)
    assert (e.ways, e.way_names, e.highway_types, e.tags) == ([7, 8], ["East"], {"path": 2, "track": 1}, {ZONE_TAG: "core", REFS_TAG: "r1,r2", STATE: "include"})
    assert found[2, 3].highway_types == {} and found[2, 3].way_names == []
    steps = spark.createDataFrame([(1, 0, 3, 2, False), (1, 1, 2, 1, False)], "contig long, pos long, u long, v long, is_cycle boolean")
    edges = attributes.edges(spark.createDataFrame(PARTS, COLUMNS), nodes)
    c = attributes.contigs(steps, edges, nodes).first()
    assert (c.node_ids, c.segments, c.way_ids, c.way_names, c.highway_types) == ([3, 2, 1], 2, [7, 8, 9], ["East"], {"path": 2, "track": 1})
    assert c.bounds == [36.0, -1.0012346, 36.001, -1.0] and c.tags == e.tags and c.length_m == round(found[1, 2].length_m + found[2, 3].length_m, 3)
    with pytest.raises(ValueError, match="edge 1-2: conflicting boundary zones"):
        attributes.edges(spark.createDataFrame([*PARTS, (5, 1, 2, "buffer", "", {})], COLUMNS), nodes)
    with pytest.raises(ValueError, match="conflicting"):
        attributes.edges(spark.createDataFrame([*PARTS, (5, 1, 2, "core", "", {STATE: "exclude"})], COLUMNS), nodes)
    other = attributes.edges(spark.createDataFrame([*PARTS[:3], (9, 2, 3, "core", "r9", {})], COLUMNS), nodes)
    with pytest.raises(ValueError, match="contig 1"):
        attributes.contigs(steps, other, nodes)


def test_edges_are_stored_once(spark):
    parts = spark.createDataFrame([(1, 1, 2, "z", "r1", {"highway": "path"}), (2, 2, 1, "z", "r2", {"highway": "path"})], "way long, a long, b long, zone string, refs string, tags map<string,string>")
    nodes, stored = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "id long, lon double, lat double"), []
    out = attributes.edges(parts, nodes, checkpoint=lambda df: stored.append(df) or df.localCheckpoint()).collect()
    assert len(stored) == 1 and [(r.a, r.b, r.ways, r.highway_types) for r in out] == [(1, 2, [1, 2], {"path": 2})]
