"""Contracts over unfolded documents: wrong types, missing parts, unknown fields; and what differs between documents."""
import json

import pytest

from pathloom.plans import contracts
from pathloom.sources import variants

POINT = {"junction_id": "gate", "name": "Gate", "graph_node_id": 1, "incident_contig_ids": [3], "location": {"lat": -1, "lon": 36.5}}
ROUTES = {
    "meta": dict.fromkeys(["asset_id", "asset_kind", "algorithm", "graph_asset_id", "graph_path", "junction_catalog_asset_id", "start_junction_id", "end_junction_id"], "x") | {"seed": 1}, "config": {"a": 1}, "start": POINT, "end": POINT | {"notes": "n", "tags": []},
    "routes": [{"complete": True, "score": 1.5, "route_node_ids": [1, 2], "steps": [{"contig_id": 3, "from_node_id": 1, "to_node_id": 2, "reused": False, "length_m": 4}]}]}
APP = {"planner": {"network_path": "n", "network_version": "v", "background_network_path": "b", "background_network_version": "w", "config": {}},
       "areas": [{"id": "a", "name": "A", "network_path": "n", "network_version": "v", "background_network_path": "b", "background_network_version": "w", "boundary_refs": ["r1"], "bounds": [1, 2.5, 3, 4],
                  "junctions": [{"id": "j", "name": "J", "location": {"lat": 1, "lon": 2}, "graph_node_id": 7}], "scenarios": [{"id": "s", "start_junction_id": "j", "end_junction_id": "j", "is_loop": True}]}]}
POLICY = {"meta": {"asset_id": "p", "asset_kind": "k"}, "rules": [{"id": "r", "selector": {"way_ids": [1], "node_ids": [1, 2]}, "policy": {"routing_state": "include", "bikeability": 3, "unavailable_until": "2024-02-29"}}]}
FIGURES = {"meta": POLICY["meta"], "figures": [{"id": "f", "kind": "k", "output_path": "o", "header": {"title": "t", "subtitle": "s"}, "items": [{"junction_id": "j", "color": [1, 2, 3, 4], "label_dx": 1, "label_dy": 0.5}]}]}
BUILD = {"debug_catalog": {"algorithms": ["beam"]}, "browser_runtime": {"browser_selection_pool": 5, "browser_mcts_time_budget_ms": 350.0}}
TOLD = {"id": "r", "algorithm": "m", "seed": 1, "complete": False, "score": -1.5, "total_length_m": 1, "unique_length_m": 1, "overlap_length_m": 0, "step_count": 2, "repeated_contig_ids": [], "bounds": [1, 2, 3, 4], "coordinates": [[1, 2], [3, 4]], "route_node_ids": [1], "contig_id_sequence": [1]}
PLAN = {"routeId": "r", "startNodeId": 1, "endNodeId": 2, "seed": 3, "recentRouteContigSequences": [[1, 2], []]}


def changed(document, **at):
    """A copy with values put at dotted paths; ``...`` takes one away."""
    out = json.loads(json.dumps(document))
    for path, value in at.items():
        *way, last = [int(p) if p.isdigit() else p for p in path.split("__")]
        inner = out
        for p in way:
            inner = inner[p]
        if value is ...:
            del inner[last]
        else:
            inner[last] = value
    return out


CASES = {
    "routes": [(ROUTES, []), (changed(ROUTES, meta__seed="1"), ["$.meta.seed must be an integer"]), (changed(ROUTES, config={}), ["$.config must be an object with a field"]), (changed(ROUTES, start=...), ["$.start must be an object"]),
               (changed(ROUTES, end__location__lat="x", end__notes=5), ["$.end.location.lat must be a number", "$.end.notes must be a string"]), (changed(ROUTES, routes__0__route_node_ids=[1, 2.5, "3"]), ["$.routes[0].route_node_ids[1] must be an integer", "$.routes[0].route_node_ids[2] must be an integer"]),
               (changed(ROUTES, routes__0__steps__0__reused=0, routes__0__complete=None), ["$.routes[0].complete must be a boolean", "$.routes[0].steps[0].reused must be a boolean"]), (changed(ROUTES, meta__algorithm=""), ["$.meta.algorithm must be a non-empty string"]), ([], ["$ must be an object"])],
    "app": [(APP, []), (changed(APP, areas=[]), ["$.areas must have at least 1 items"]), (changed(APP, areas__0__bounds=[1, 2, 3]), ["$.areas[0].bounds must have at least 4 items"]), (changed(APP, areas__0__bounds=[1, 2, 3, 4, 5]), ["$.areas[0].bounds must have at most 4 items"]),
            (changed(APP, areas__0__scenarios__0__is_loop="yes", planner__config=...), ["$.areas[0].scenarios[0].is_loop must be a boolean", "$.planner.config must be an object"])],
    "policy": [(POLICY, []), (changed(POLICY, rules__0__policy={}), ["$.rules[0].policy must be an object with a field"]), (changed(POLICY, rules__0__policy={"colour": 1, "bikeability": 6}), ["$.rules[0].policy.bikeability must be an integer from 1 to 5", "$.rules[0].policy.colour is not a known field"]),
               (changed(POLICY, rules__0__policy__unavailable_until="2024-02-30", rules__0__policy__routing_state="maybe"), ["$.rules[0].policy.routing_state must be one of include, exclude", "$.rules[0].policy.unavailable_until must be a valid YYYY-MM-DD date"]),
               (changed(POLICY, rules__0__selector__node_ids=[1]), ["$.rules[0].selector.node_ids must have at least 2 items"])],
    "figures": [(FIGURES, []), (changed(FIGURES, figures__0__items__0__color=[1, 2, 3, "4"], figures__0__header__title=...), ["$.figures[0].header.title must be a non-empty string", "$.figures[0].items[0].color[3] must be an integer"])],
    "build": [(BUILD, []), ({}, []), (changed(BUILD, extra=1, browser_runtime__browser_selection_pool=0), ["$.browser_runtime.browser_selection_pool must be a positive integer", "$.extra is not a known field"]), (changed(BUILD, browser_runtime__browser_mcts_time_budget_ms=True, planner=[]), ["$.browser_runtime.browser_mcts_time_budget_ms must be a positive number", "$.planner must be an object"])],
    "route": [(TOLD, []), (TOLD | {"elevations_m": [1, "2"]}, ["$.elevations_m[1] must be a number"]), (TOLD | {"coordinates": [[1, 2]]}, ["$.coordinates must have at least 2 items"]), (TOLD | {"coordinates": [[1, 2], [3]]}, ["$.coordinates[1] must have at least 2 items"])],
    "plan": [(PLAN, []), (PLAN | {"recentRouteContigSequences": None}, []), (PLAN | {"recentRouteContigSequences": [[1, "2"]], "seed": 1.5}, ["$.recentRouteContigSequences[0][1] must be an integer", "$.seed must be an integer"])],
    "history": [([[1], []], []), ({}, ["$ must be an array"]), ([[1], 2], ["$[1] must be an array"])],
    "planned": [({"requestId": 1, "payload": TOLD}, []), ({"requestId": "1", "payload": changed(TOLD, bounds=[1, 2, 3, None])}, ["$.payload.bounds[3] must be a number", "$.requestId must be an integer"])],
    "ready": [({"requestId": 1, "payload": {"contigCount": 1, "nodeCount": 2}}, []), ({"requestId": 1, "payload": {"contigCount": "1"}}, ["$.payload.contigCount must be an integer", "$.payload.nodeCount must be an integer"])],
    "editor": [({"meta": dict.fromkeys(["editor_graph_asset_id", "route_policy_path", "route_policy_digest", "generated_at"], "x"), "editor": {"network_path": "n", "network_version": "v"}}, []), ({"meta": {}, "editor": 1}, sorted([f"$.meta.{n} must be a non-empty string" for n in ("editor_graph_asset_id", "route_policy_path", "route_policy_digest", "generated_at")] + ["$.editor must be an object"]))],
}


@pytest.fixture(scope="module")
def rows(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    texts = [(f"{name}/{k}", json.dumps(d)) for name, cases in CASES.items() for k, (d, _) in enumerate(cases)] + [("routes/none", "no json"), ("app/ends", json.dumps(changed(APP, areas__0__scenarios__0__end_junction_id="other")))]
    return variants.unfolded(variants.documents(spark.createDataFrame(texts, "doc string, text string"))).persist()


@pytest.mark.parametrize("name", CASES)
def test_contract(rows, name):
    found = {}
    for r in contracts.problems(rows.where(f"doc LIKE '{name}/%'"), contracts.CONTRACTS[name]).collect():
        found.setdefault(r.doc, []).append(f"{r.path} {r.problem}")
    for k, (_, want) in enumerate(CASES[name]):
        assert sorted(found.get(f"{name}/{k}", [])) == sorted(want), (name, k)
    if name == "routes":
        assert found["routes/none"] == ["$ must be an object"]


def test_unknown_ends(rows):
    assert [tuple(r) for r in contracts.unknown_ends(rows).collect()] == [("app/ends", "$.areas[0].scenarios[0].end_junction_id", "is no junction of its area")]


def test_differences(spark):
    before = {"meta": {"generated_at": "a", "n": 1.0, "odd key": [1, {"x": []}]}, "list": [1, 2, {"a": "é"}], "gone": None}
    after = {"list": [1, 2.5, {"a": "é"}, {}], "meta": {"n": 1, "generated_at": "b", "odd key": [1, {"x": {}}]}}
    one, two = (variants.unfolded(variants.documents(spark.createDataFrame([("d", json.dumps(x)), ("same", "[1]")], "doc string, text string"))) for x in (before, after))
    found = variants.compared(one, two, (r"\$\.meta\.generated_at",))
    assert {r.path: (r.before, r.after) for r in found.collect()} == {"$.gone": ("VOID null", None), "$.list[1]": ("NUMBER 2", "NUMBER 2.5"), "$.list[3]": (None, "OBJECT"), '$.meta."odd key"[1].x': ("ARRAY", "OBJECT")}
    assert [tuple(r) for r in variants.first_difference(found).collect()] == [("d", "$.gone", 4)]


def test_rules_meet_values_by_place_and_only_bits_are_shuffled(spark):
    """More than 60 rules of one object, missing and null and optional ones; no join deals the values anew."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rules = [contracts.Rule("$", "object"), *contracts.each("$", "integer", *(f"n{k}" for k in range(130))), *contracts.each("$.in", "integer", "x"), *contracts.each("$", "string", "may", optional=True)]
    texts = [(1, json.dumps({f"n{k}": k for k in range(130) if k not in (0, 59, 60, 129)} | {"n5": None, "in": {}})), (2, json.dumps({f"n{k}": 1 for k in range(130)} | {"may": 3})), (3, "no JSON"), (4, "{}")]
    rows = variants.unfolded(variants.documents(spark.createDataFrame(texts, "doc long, text string")))
    found = contracts.problems(rows, rules)
    integer = "must be an integer"
    expected = {(1, f"$.n{k}", integer) for k in (0, 5, 59, 60, 129)} | {(1, "$.in.x", integer), (2, "$.may", "must be a non-empty string"), (3, "$", "must be an object")} | {(4, f"$.n{k}", integer) for k in range(130)}
    assert {tuple(r) for r in found.collect()} == expected
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in contracts.problems(rows, rules)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_say_what_leaves_say(spark):
    """Documents side by side differ as their unfolded leaves do, also below the levels of one pass, and without a table of leaves."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    one = ['{"a":{"b":[1,{"c":[{"d":{"e":[1,2,{}]}}]}]},"v":{"x":1}}', '{"n":1.50,"s":"1","t":null,"u":true}', '{"x":5,"y":{},"z":[]}', "no JSON", "[1,2]", '"only here"', '{"same":[{"k":1e0}]}', '{"odd key":{"a\\"b":1}}']
    two = ['{"a":{"b":[1,{"c":[{"d":{"e":[1,3,[]],"f":{"g":{"h":0}}}}]}]},"v":{"x":2}}', '{"n":1.5,"s":1,"u":false}', '{"x":{"p":[7]},"y":[],"z":[[]]}', "{}", '{"0":1}', None, '{"same":[{"k":1}]}', '{"odd key":{"a\\"b":2}}']
    before, after = (variants.documents(spark.createDataFrame([(k, t) for k, t in enumerate(texts) if t is not None], "doc long, text string")) for texts in (one, two))
    skipped = (r"\$\.v",)
    stored = []

    def checkpoint(df):
        stored.append(df.checkpoint())
        return stored[-1]

    found = sorted(map(tuple, variants.changes(variants.paired(before, after), skipped, checkpoint).collect()), key=str)
    assert found == sorted(map(tuple, variants.compared(variants.unfolded(before), variants.unfolded(after), skipped).collect()), key=str)
    assert {d for d, *_ in found} == {0, 1, 2, 3, 4, 5, 7} and len(stored) == 3 and stored[0].count() < 25
