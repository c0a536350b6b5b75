"""Tags of rules on edges: one meeting by edge, with doubled edges, values that disagree, nulls and rules off the network."""
from pathloom.operators import policies


def test_edges_and_rules_meet_once(spark):
    edges = spark.createDataFrame([(1, 2, {"base": "y"}), (2, 3, {"base": "y"}), (2, 3, {"base": "y"}), (3, 4, None), (4, 5, {"grade": "1"})], "a long, b long, tags map<string,string>")
    selectors = spark.createDataFrame([(7, 1, 2), (7, 2, 3), (8, 2, 3), (8, 4, 5), (9, 4, 5), (8, 9, 10), (99, 1, 2)], "id long, a long, b long")
    rules = spark.createDataFrame([(7, {"grade": "1", "none": None}), (8, {"grade": "2"}), (9, {"grade": None, "state": "in"})], "id long, tags map<string,string>")
    out = policies.onto_edges(selectors, rules, edges)
    found = sorted((r.a, r.b, sorted(r.tags.items()), r.conflicts) for r in out.collect())
    double = (2, 3, [("base", "y")], ["grade"])
    assert found == [(1, 2, [("base", "y"), ("grade", "1")], []), double, double, (3, 4, [], []), (4, 5, [("state", "in")], ["grade"])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(a#" in line for line in plan.split("== Initial Plan ==")[-1].splitlines()) <= 1
