"""Rings, clipping, patches and contigs on small cases with known answers, and against loops."""
import random

from pyspark.sql import functions as F

from pathloom.operators import contigs, mapping, patches

SQUARE = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0), (4, 0.0, 1.0)]  # id, lon, lat


def ready(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def test_rings_from_fragments():
    assert mapping.joined([[1, 2], [3, 2], [3, 4, 1]]) == [[1, 2, 3, 4, 1]]
    assert mapping.joined([[1, 2], [2, 3]]) == []
    assert mapping.joined([[2, 3], [1, 2], [9, 8, 9], [3, 1]]) == [[2, 3, 1, 2], [9, 8, 9]]
    chain = [[k, k + 1] if k % 2 else [k + 1, k] for k in range(20_000)] + [[20_000, 0]]
    assert [len(r) for r in mapping.joined(chain)] == [20_002]
    assert mapping.joined([[5, 6, 7, 5], [1, 2], [2, 1], [9]]) == [[5, 6, 7, 5], [1, 2, 1]]


def world(spark, extra):
    nodes = spark.createDataFrame([*SQUARE, *extra], "id long, lon double, lat double")
    members = spark.createDataFrame([("r1", "outer", 0, [1, 2, 3]), ("r1", "outer", 1, [1, 4, 3])], "component string, kind string, ord int, nodes array<long>")
    return nodes, mapping.ring_edges(mapping.rings(members), nodes)


def rows(spark, path, way=10):
    return spark.createDataFrame([(way, k, a, b) for k, (a, b) in enumerate(zip(path, path[1:]))], "way long, pos long, a long, b long")


def test_clipping_keeps_by_either_end_and_fills_gaps(spark):
    nodes, edges = world(spark, [(11, 0.5, 0.5), (12, 1.2, 0.5), (13, 1.3, 0.5), (14, 0.8, 0.5), (15, 2.0, 0.5)])
    parts = rows(spark, [11, 12, 13, 14, 15])
    out = {r.pos: r for r in mapping.clipped(parts, nodes, edges).collect()}
    assert [out[k].zone for k in range(4)] == ["buffer", "outside", "buffer", "buffer"] and all(out[k].keep and out[k].refs == ["r1"] for k in range(4))
    assert out[1].kept_zone == "buffer"
    assert [r.keep for r in sorted(mapping.clipped(parts, nodes, edges, fill=False).collect(), key=lambda r: r.pos)] == [True, False, True, True]
    record = mapping.way_records(mapping.clipped(parts, nodes, edges)).first()
    again = mapping.way_records(mapping.clipped(parts, nodes, edges), kept_only=False).first()
    assert record.inside_m == 0 and abs(record.total_m - record.buffer_m) < 1e-6 and again.buffer_m < again.total_m
    middle = {r.pos: r.zone for r in mapping.clipped(parts, nodes, edges, mode=mapping.MIDPOINT).collect()}
    assert middle == {0: "core", 1: "outside", 2: "outside", 3: "outside"}
    assert mapping.way_records(mapping.clipped(rows(spark, [13, 15]), nodes, edges, mode=mapping.ALL)).first().inside_m == 0
    assert mapping.way_records(mapping.clipped(rows(spark, [13, 15]), nodes, edges)).count() == 0


def test_buffer_and_holes(spark):
    nodes, edges = world(spark, [(21, 1.00015, 0.9), (22, 1.00035, 0.9)])
    r = mapping.clipped(rows(spark, [21, 22]), nodes, edges, 60.0).first()
    assert (r.zone, r.refs) == ("buffer", ["r1"])
    assert mapping.clipped(rows(spark, [21, 22]), nodes, edges, 0.0).first().zone == "outside"
    hole = [(31, 0.2, 0.2), (32, 0.4, 0.2), (33, 0.4, 0.4), (34, 0.2, 0.4)]
    many = spark.createDataFrame([*SQUARE, *hole], "id long, lon double, lat double")
    found = spark.createDataFrame([("r1", "outer", 0, [1, 2, 3, 4, 1]), ("r1", "inner", 0, [31, 32, 33, 34, 31])], "component string, kind string, ring int, nodes array<long>")
    point = spark.createDataFrame([(1, 0.3, 0.3), (2, 0.8, 0.8)], "id long, lon double, lat double")
    both = [{r.id: r.core for r in mapping.membership(point, mapping.ring_edges(found, many), 0.0, holes).collect()} for holes in (False, True)]
    assert both == [{1: ["r1"], 2: ["r1"]}, {1: [], 2: ["r1"]}]
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3, 1])], "way long, nodes array<long>")
    assert [r.way for r in mapping.open_rings(ways).collect()] == [1]


PATCH = "ord int, id string, enabled boolean, op string, way long, nodes array<long>, tags map<string,string>, `set` map<string,string>, remove array<string>, new_nodes array<struct<id:bigint,lon:double,lat:double>>"


def test_patches_in_order(spark):
    ways = spark.createDataFrame([(10, [11, 12], {"highway": "path", "name": "Original"}), (20, [12, 13], {"highway": "track"}), (30, [1, 2], {})], "way long, nodes array<long>, tags map<string,string>")
    table = [
        (1, "retag", True, patches.RETAG, 10, None, None, {"surface": "gravel"}, ["name"], None), (2, "move", True, patches.REPLACE, 10, [11, 14], None, None, None, [(14, 0.6, 0.6)]),
        (3, "drop", True, patches.REMOVE, 20, None, None, None, None, None), (4, "add", True, patches.ADD, -100, [14, -1], {"highway": "path"}, None, None, [(-1, 0.7, 0.7)]),
        (5, "off", False, patches.REMOVE, 10, None, None, None, None, None), (6, "again", True, patches.ADD, 20, [5, 6], {"k": "v"}, None, None, None),
        (7, "late", True, patches.REMOVE, 99, None, None, None, None, None), (8, "twice", True, patches.ADD, 30, [3], {}, None, None, None)]
    df = spark.createDataFrame(table, PATCH)
    out = {r.way: r for r in patches.applied(ways, df).collect()}
    assert (out[10].nodes, out[10].tags) == ([11, 14], {"highway": "path", "surface": "gravel"})
    assert (out[-100].nodes, out[20].nodes, out[20].tags) == ([14, -1], [5, 6], {"k": "v"})
    assert out[99].problem == "late: way is missing" and out[30].problem == "twice: way exists" and out[30].nodes == [1, 2]
    nodes = spark.createDataFrame([(14, 0.6, 0.6), (-1, 0.0, 0.0)], "id long, lon double, lat double")
    assert [r.id for r in patches.moved_nodes(nodes, df).collect()] == [-1] and patches.with_nodes(nodes, df).count() == 2
    bad = spark.createDataFrame([*table, (9, "off", True, "melt", 1, None, None, None, None, None)], PATCH)
    assert {tuple(r) for r in patches.violations(bad).collect()} == {("off", "duplicate id"), ("off", "unsupported operation")}
    one, other = patches.digest(df, "75").first(), patches.digest(df, "60").first()
    assert one.ids == ["retag", "move", "drop", "add", "again", "late", "twice"] and len(one.digest) == 12 and one.digest != other.digest


def walked(edges, kind):
    """Contigs by walking: sorted crossings, sorted neighbours, then cycles by edge."""
    around = {}
    for a, b in edges:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    key = lambda a, b: (min(a, b), max(a, b))
    stops = {n for n, x in around.items() if len(x) != 2 or len({kind(*key(n, y)) for y in x}) != 1}
    seen, out = set(), []

    def go(path, cycle):
        while True:
            seen.add(key(*path[-2:]))
            if path[-1] in stops or (cycle and path[-1] == path[0]):
                return
            path.append(next(x for x in around[path[-1]] if x != path[-2]))

    for c in sorted(stops):
        for x in sorted(around[c]):
            if key(c, x) not in seen:
                go(path := [c, x], False)
                out.append((path, False))
    for a, b in sorted(edges):
        if (a, b) not in seen:
            go(path := [a, b], True)
            out.append((path, True))
    return out


def test_contigs_against_a_walk(spark):
    ready(spark)
    rng = random.Random(3)
    edges = {(k, k + 1) for k in range(300)} | {(1000 + k, 1001 + k) for k in range(8)} | {(1000, 1008), (2000, 2001), (2001, 2002), (2000, 2002)}
    edges |= {tuple(sorted(rng.sample(range(0, 301), 2))) for _ in range(12)} | {(3000, 3001), (3001, 3002), (3000, 3002), (3000, 3003)}
    kind = lambda a, b: int(a == 50)
    df = spark.createDataFrame([(a, b, 1.5, [a % 3]) for a, b in sorted(edges)], "a long, b long, length_m double, ways array<long>")
    steps = contigs.ordered(df, F.col("a") == 50)
    out = [(r.node_ids, r.is_cycle) for r in sorted(contigs.records(steps, df).collect())]
    assert out == walked(edges, kind)
    assert all(r.length_m == 1.5 * r.segments for r in contigs.records(steps, df).collect())


def test_edges_between_crossings_are_not_walked(spark):
    """Of a network of crossings only the edges and their numbers are stored, not places along chains."""
    ready(spark)
    df = spark.createDataFrame([(a, b, 2.0, [b, a, b]) for a in range(9) for b in range(a + 1, 9)], "a long, b long, length_m double, ways array<long>")
    stored = []

    def checkpoint(table):
        stored.append(table.checkpoint())
        return stored[-1]

    found = sorted(contigs.laid(df, checkpoint=checkpoint).collect())
    assert [(r.contig, r.node_ids, r.segments, r.length_m, r.is_cycle, r.way_ids) for r in found] == [(k, [a, b], 1, 2.0, False, [a, b]) for k, (a, b) in enumerate(((a, b) for a in range(9) for b in range(a + 1, 9)), 1)]
    assert sum(t.count() for t in stored) == 36


def test_long_contigs_beside_edges_between_crossings(spark):
    """A loop at a crossing and a cycle without one keep their order, lengths and ways."""
    ready(spark)
    edges = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 20), (20, 21), (21, 22), (3, 22), (70, 71), (71, 72), (70, 72)]
    df = spark.createDataFrame([(a, b, a + b + 0.25, [b, a]) for a, b in edges], "a long, b long, length_m double, ways array<long>")
    found = [(r.contig, r.node_ids, r.segments, r.length_m, r.is_cycle, r.way_ids) for r in sorted(contigs.laid(df).collect())]
    short = [(k, [a, b], 1, a + b + 0.25, False, [a, b]) for k, (a, b) in enumerate(edges[:6], 1)]
    assert found == [*short, (7, [3, 20, 21, 22, 3], 4, 133.0, False, [3, 20, 21, 22]), (8, [70, 71, 72, 70], 3, 426.75, True, [70, 71, 72])]
