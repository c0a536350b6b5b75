"""Small cases with known answers, and folds against a loop."""
import math

from pathloom.operators import network, series


def metres(a, b):
    (x1, y1), (x2, y2) = ([math.radians(v) for v in p] for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_fill(spark):
    df = spark.createDataFrame([(1, 0, 100.0), (1, 1, None), (1, 2, None), (1, 3, 112.0), (2, 0, None)], "k int, p int, v double")
    out = {(r.k, r.p): r.filled for r in series.fill_missing(df, "k", ["p"], "v").collect()}
    assert out == {(1, 0): 100, (1, 1): 104, (1, 2): 108, (1, 3): 112, (2, 0): None}


def test_thin_against_a_loop(spark):
    points = {k: [(36 + (k * 7 + p * p) % 13 / 1000, -1 + (p * 5 + k) % 11 / 1000) for p in range(k + 1)] for k in range(9)}
    df = spark.createDataFrame([(k, p, *xy) for k, path in points.items() for p, xy in enumerate(path)], "way long, pos long, lon double, lat double")
    for r in series.thin(df, "way", "pos", 600.0).collect():
        path, kept = points[r.way], [0]
        for p in range(1, len(path)):
            if metres(path[kept[-1]], path[p]) >= 600:
                kept.append(p)
        assert r.kept == list(dict.fromkeys([*kept, len(path) - 1]))


def test_shortest_takes_the_longer_way_round_when_it_is_nearer(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    e = spark.createDataFrame([(1, 2, 9), (1, 3, 1), (2, 3, 2), (4, 5, 1)], "a long, b long, length long")
    assert {r.node: r.distance for r in network.shortest(e, 1, 3).collect()} == {1: 0, 3: 1, 2: 3}


def test_bindings(spark):
    rules = spark.createDataFrame([(1, 1, 11, 12), (1, 2, 12, 13), (2, 1, 13, 12), (3, 1, 1, 2), (4, 1, 12, 13), (4, 2, 13, 14)], "way long, pos long, a long, b long")
    edges = spark.createDataFrame([(11, 12, 7), (12, 13, 7), (13, 14, 8)], "a long, b long, contig long")
    assert {r.way: (r.contigs, r.status) for r in network.bindings(rules, edges).collect()} == {1: ([7], "exact"), 2: ([7], "exact"), 3: ([], "stale"), 4: ([7, 8], "split")}
