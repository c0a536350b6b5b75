"""Work that grows with the input is dealt out, and is the same whole result."""
import random

from pyspark.sql import functions as F

from pathloom.functions import text
from pathloom.operators import network, places, routes
from pathloom.plans import catalogue, inputs


def test_pairs_of_a_large_group_are_dealt_to_slices(spark, monkeypatch):
    monkeypatch.setattr(places, "PAIRS", 50)
    rows = spark.createDataFrame([(0, k) for k in range(40)] + [(1, 100), (1, 101)], "area long, key long")
    pairs = places.all_pairs(rows, "area", "key")
    assert pairs.rdd.getNumPartitions() == 64
    assert sorted(map(tuple, pairs.collect())) == sorted([(0, a, b) for a in range(40) for b in range(40)] + [(1, a, b) for a in (100, 101) for b in (100, 101)])


def test_a_place_is_searched_for_once(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    asked, search = [], places._nearest

    def counted(points, nodes, cell):
        asked.append(points.count())
        return search(points, nodes, cell)

    monkeypatch.setattr(places, "_nearest", counted)
    nodes = spark.createDataFrame([(7, 36.8, -1.2), (8, 36.8, -1.2), (9, 36.81, -1.21)], "id long, lon double, lat double")
    points = spark.createDataFrame([(k, *((36.81, -1.21) if k % 2 else (36.8, -1.2))) for k in range(200)] + [(5, 36.81, -1.21), (300, None, -1.2)], "id long, lon double, lat double")
    out = sorted((r.id, r.node) for r in places.nearest(points, nodes).collect())
    assert asked == [3]  # the one without a place has no nearest
    assert out == [(k, 9 if k % 2 else 7) for k in range(200)]


def test_diverse_runs_of_many_scenarios_in_one_call(spark):
    rng = random.Random(5)
    rows = [(s, 100 * s + k, rng.choice([None, 1.0, 2.0, 5.5]) if s == 3 else float(rng.randrange(9)), float(rng.randrange(1, 9)), float(rng.randrange(4)), float(rng.randrange(20)), [rng.randrange(6) for _ in range(rng.randrange(4))]) for s in range(30) for k in range(rng.randrange(1, 50))]
    frame = spark.createDataFrame(rows, "scenario long, run long, quality double, distinct_length double, overlap double, total double, items array<long>")
    out = routes.diverse(frame, 4)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    found = sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[3]))
    expected = []
    for s in range(30):
        group = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))[:36]
        if s == 3:
            assert [r[3] for r in found if r[0] == 3] == list(range(1, min(4, len(group)) + 1))
            continue
        q, u, chosen = max(r[2] for r in group) or 1.0, max(r[3] for r in group) or 1.0, [0]
        like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0
        while len(chosen) < min(4, len(group)):
            worth = lambda i: 2.4 * min(1 - (like(group[i][6], group[j][6]) if group[i][6] or group[j][6] else 1) for j in chosen) + 1.2 * group[i][2] / q + 0.6 * group[i][3] / u - 0.8 * group[i][4] / max(1.0, group[i][5])  # noqa: E731, B023
            chosen.append(max((i for i in range(len(group)) if i not in chosen), key=lambda i: (worth(i), -i)))
        expected += [(s, group[i][1], group[i][2], place) for place, i in enumerate(sorted(chosen), 1)]
    assert [r for r in found if r[0] != 3] == expected


def test_a_walk_meets_the_arcs_of_its_node_as_one_short_list(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    star = spark.createDataFrame([(0, k, float(k)) for k in range(1, 51)] + [(1, 2, 9.0), (2, 3, 9.0)], "a long, b long, length double")
    runs = spark.createDataFrame([(r, r, 0, -1) for r in range(20)], "run long, seed long, start long, goal long")
    made = []

    def kept(df):
        made.append(df.checkpoint())
        return made[-1]

    out = sorted(map(tuple, routes.planned(runs, star, 3, kept).collect()))
    assert made[0].count() == 51 and max(len(r["next"]) for r in made[0].collect()) == 6
    monkeypatch.setattr(routes, "FEW", 0)
    assert sorted(map(tuple, routes.planned(runs, star, 3).collect())) == out


def test_a_polyline_reads_its_points_once(spark):
    line = text.polyline(F.col("p"))
    assert str(line).count("rint") <= 2
    rows = [(1, [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]), (2, []), (3, [(0.0, 0.0)]), (4, None), (5, [(180.0, -90.0), (-180.0, 90.0)])]
    out = {r.k: r.line for r in spark.createDataFrame(rows, "k int, p array<struct<lon:double,lat:double>>").select("k", line.alias("line")).collect()}


    def plain(points):
        signs, before = "", (0, 0)
        for lon, lat in points:
            at = (round(lat * 1e5), round(lon * 1e5))
            for d in (at[0] - before[0], at[1] - before[1]):
                v = -2 * d - 1 if d < 0 else 2 * d
                while v >= 32:
                    signs, v = signs + chr(v % 32 + 95), v // 32
                signs += chr(v + 63)
            before = at
        return signs

    assert out == {k: None if p is None else plain(p) for k, p in rows} and out[1] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_a_large_table_is_dealt_over_more_tasks(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    names = ("contig_visits", "policy_runs", "pairwise_jaccard", "history_pick")
    before = {n: sorted(map(tuple, catalogue.QUERIES[n](spark, folder).collect())) for n in names}
    assert inputs.tasks(spark, folder, "lineitem") is None
    monkeypatch.setattr(inputs, "SHARE", 100_000)
    n = inputs.tasks(spark, folder, "lineitem")
    assert n > 8
    for name in names:
        out = catalogue.QUERIES[name](spark, folder)
        assert f", {n}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == before[name]


def test_few_new_nodes_are_sent_to_the_arcs(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(0, 1, 5), (0, 2, 1), (2, 1, 1), (1, 3, 1), (7, 8, 1)], "a long, b long, length long")
    threshold, found = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (network.FEW, 0):
            monkeypatch.setattr(network, "FEW", few)
            plans = []

            def kept(df):
                plans.append(df._jdf.queryExecution().executedPlan().toString())  # noqa: B023
                return df.checkpoint()

            found[few] = [sorted(map(tuple, f(edges, 0, checkpoint=kept).collect())) for f in (network.shortest, network.reachable)]
            assert any("BroadcastHashJoin" in p for p in plans) == bool(few)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found[0] == found[100_000] == [[(0, 0), (1, 2), (2, 1), (3, 3)], [(0, 0), (1, 1), (2, 1), (3, 2)]]
