"""Beam search and its draws on small networks, against loops."""
from collections import Counter

from pyspark.sql import functions as F

from pathloom.operators import planning, policies, routes, search, series
from planners import Loop


def arcs(spark, edges):
    rows = [(x, y, c, float(m)) for c, a, b, m in edges for x, y in sorted({(a, b), (b, a)})]
    return spark.createDataFrame(rows, "at long, to long, contig long, length_m double")


def all_routes(loop, start, goal):
    """What a beam comes to that keeps everything."""
    out, todo = {}, [loop.start(start)]
    while todo:
        w = todo.pop()
        if w.at == goal and w.contigs:
            out[w.contigs] = w
        options = [o for o, _ in loop.options(w, goal) if not (w.at == goal and w.contigs and o.at == goal)]
        if not options and w.at != goal or not w.contigs and not options:
            end = loop.connected(w, goal)
            out[end.contigs] = end
        todo += options
    return out


def test_wide_beam_finds_all(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = [(10, 1, 2, 100), (20, 2, 4, 120), (30, 1, 3, 90), (40, 3, 4, 150), (50, 2, 3, 30), (60, 4, 5, 25)]
    runs = spark.createDataFrame([(1, 7, 1, 4), (2, 7, 1, 1), (3, 7, 9, 4), (4, 7, 1, 77)], "run long, seed long, start long, goal long")
    rules = planning.Rules(keep=10_000, pool=3, slices=3)
    found = search.beam(runs, arcs(spark, edges), width=5000, branch=20, rules=rules).collect()
    loop = Loop(edges, rules)
    for run, start, goal in ((1, 1, 4), (2, 1, 1), (3, 9, 4), (4, 1, 77)):
        want = all_routes(loop, start, goal)
        own = [r for r in found if r.run == run]
        assert {tuple(r.contigs): (r.total, r.distinct_length, r.overlap, r.complete) for r in own} == {c: (w.distinct + w.overlap, w.distinct, w.overlap, w.at == goal) for c, w in want.items()}
        assert all(abs(r.score - loop.worth(want[tuple(r.contigs)], goal)) < 1e-9 for r in own)
        assert sorted(r["rank"] for r in own) == list(range(1, len(own) + 1))
        rest = [r for r in sorted(own, key=lambda r: r["rank"])][1:]
        assert rest == sorted(rest, key=lambda r: (not r.complete, -r.distinct_length, r.overlap, -r.score, len(r.contigs), r.contigs))


def test_only_way_through(spark):
    """Two arms, one of which is barred: every planner setting finds the other."""
    open_ = arcs(spark, [(30, 1, 3, 100), (40, 3, 4, 100), (10, 1, 2, 100)])
    runs = spark.createDataFrame([(1, 7, 1, 4)], "run long, seed long, start long, goal long")
    for width in (1, 80):
        r = search.beam(runs, open_, width=width, branch=3, rounds=6).collect()
        assert [(x.contigs, x.nodes, x.complete) for x in r] == [([30, 40], [1, 3, 4], True)]


def test_seeds_differ(spark):
    edges = [(10 * a + b, a, b, 60 + 7 * ((a * b) % 5)) for a in range(6) for b in range(a + 1, 6) if (a + b) % 4]
    runs = spark.createDataFrame([(s, s, 0, 5) for s in range(1, 7)], "run long, seed long, start long, goal long")
    found = search.beam(runs, arcs(spark, edges), width=6, branch=2, rules=planning.Rules(steps=12)).collect()
    first = {r.run: r for r in found if r["rank"] == 1}
    assert all(r.complete for r in first.values()) and len({tuple(r.contigs) for r in first.values()}) > 1


def test_choices(spark):
    runs = spark.createDataFrame([(1, 10, 1, 9.0, [1, 2]), (1, 11, 2, 8.0, [1, 2]), (1, 12, 3, 7.0, [2, 3]), (1, 13, 4, 1.0, [7]), (2, 20, 1, 1.0, [])], "scenario long, run long, rank int, score double, items array<int>")
    assert [r.run for r in sorted(routes.diverse_pool(runs.where("scenario = 1"), 3).collect(), key=lambda r: r.place)] == [10, 13, 12]
    assert routes.diverse_pool(runs, 2).where("scenario = 2").count() == 1
    chosen = runs.where("run = 12")
    assert [r.run for r in routes.reordered(runs.where("scenario = 1"), chosen).orderBy("rank").collect()] == [12, 10, 11, 13]
    first = Counter(routes.drawn(runs.where("scenario = 1"), 4, 1, seed).first().run for seed in range(120))
    assert first[10] > first[13] and set(first) == {10, 11, 12, 13}


def test_thin_path_has_a_cap(spark):
    points = spark.createDataFrame([(1, p, 36 + p / 100, -1.0) for p in range(50)], "way long, pos long, lon double, lat double")
    kept = series.thin(points, "way", "pos", 10.0, 10).first().kept
    assert kept == [*range(0, 49, 6), 49]
    # Over several parts of the path, as by a plain loop.
    line = [(2, p, 36 + p * 0.00031, -1.0) for p in range(900)]
    want, metres = [0], 0.00031 * 3.141592653589793 / 180 * 6371000 * 0.9998476951563913
    for p in range(1, 900):
        if (p - want[-1]) * metres >= 100.0:
            want.append(p)
    assert series.thin(spark.createDataFrame(line, "way long, pos long, lon double, lat double"), "way", "pos", 100.0, 2000).first().kept == [*want, 899][: len(want) + (want[-1] != 899)]


def test_policies_of_paths(spark):
    edges = spark.createDataFrame([(1, 2, 7, 0, 2), (2, 3, 7, 1, 2), (3, 4, 8, 0, 1)], "a long, b long, contig long, place int, size int")
    rules = spark.createDataFrame([("exact", 0, 1, 2), ("exact", 1, 2, 3), ("back", 0, 2, 3), ("back", 1, 1, 2), ("part", 0, 1, 2), ("both", 0, 2, 3), ("both", 1, 3, 4), ("gone", 0, 8, 9)], "id string, pos int, a long, b long").withColumn("way_ids", F.array(F.lit(1)))
    assert {r.id: (r.contigs, r.status) for r in policies.bound(rules, edges).collect()} == {"exact": ([7], "exact"), "back": ([7], "reversed"), "part": ([7], "split_across_contigs"), "both": ([7, 8], "split_across_contigs"), "gone": ([], "stale")}
    kept = spark.createDataFrame([(1, {"a": "1"}), (2, {"a": "1"}), (3, {"a": "1"})], "contig int, policy map<string,string>")
    edits = spark.createDataFrame([(1, 1, {"a": "2"}), (2, 1, {"b": "3"}), (3, 2, None), (4, 9, {"c": "4"}), (5, 3, {})], "ord int, contig int, policy map<string,string>")
    assert {r.contig: r.policy for r in policies.edited(kept, edits).collect()} == {1: {"b": "3"}, 9: {"c": "4"}}
    tags = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (1, {"b": "2", "a": "1"}), (2, {}), (2, {"a": "1"})], "contig int, tags map<string,string>")
    assert [r.contig for r in policies.uneven(tags, "contig").collect()] == [2]
