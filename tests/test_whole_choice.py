"""No candidate is left out for its place or its number."""
from pathloom.operators import routes
from pathloom.plans import catalogue


def test_all_runs_of_a_scenario_take_part(spark, tmp_path):
    """The 40th run by quality is the only one that shares no item with the best."""
    orders = [(r, 1, "F") for r in range(40)]
    lines = [(r, k + 1, 900 + k if r == 39 else k, 100.0 - r, 1.0) for r in range(40) for k in range(3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = sorted(catalogue.QUERIES["diverse_selection"](spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert [r.run for r in out] == [0, 1, 2, 39]


def test_nulls_and_empty_sets_in_a_choice(spark):
    rows = [(1, 1, 5.0, 1.0, 0.0, 1.0, [1]), (1, 2, None, 1.0, 0.0, 1.0, [2]), (1, 3, float("nan"), 1.0, 0.0, 1.0, []), (1, 4, 4.0, 1.0, 0.0, 1.0, None), (2, 9, 0.0, 0.0, 0.0, 0.0, []), (2, 8, 0.0, 0.0, 0.0, 0.0, [])]
    frame = spark.createDataFrame(rows, "scenario long, run long, quality double, distinct_length double, overlap double, total double, items array<long>")
    found = sorted((r.scenario, r.place, r.run) for r in routes.diverse(frame, 3, window=None).collect())
    assert found == [(1, 1, 1), (1, 2, 4), (1, 3, 2), (2, 1, 8), (2, 2, 9)]


def test_junctions_are_bound_to_any_node(spark, tmp_path):
    """The nearest node of the junction has a number that three divides; it has a way."""
    spark.createDataFrame([(0,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(7, 1, 0), (7, 2, 1), (7, 3, 2)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [(r.id, r.node, r.incident) for r in catalogue.QUERIES["junction_bindings"](spark, str(tmp_path)).collect()] == [(0, 0, "0-1")]
