"""Network queries against loops over every way of the smallest tables."""
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from pathloom.operators import network, routes
from pathloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts():
    """way -> its segments (a, b) in order."""
    rows = pq.read_table(f"{FOLDER}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey"]).to_pylist()
    nodes = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["l_orderkey"], r["l_linenumber"], r["l_partkey"])):
        nodes[r["l_orderkey"]].append(r["l_partkey"])
    return {way: [(a, b) for a, b in zip(p, p[1:]) if a != b] for way, p in nodes.items()}


@pytest.fixture(scope="module")
def edges(parts):
    return {(min(s), max(s)) for path in parts.values() for s in path}


@pytest.fixture(scope="module")
def around(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def groups(items, linked):
    """The connected groups of ``items``."""
    left, out = set(items), []
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            new = {x for x in linked(todo.pop()) if x in left}
            left -= new
            group |= new
            todo += new
        out.append(group)
    return out


def test_degrees(spark, around):
    out = {r.node: (r.degree, r.crossing) for r in catalogue.QUERIES["node_degree_crossings"](spark, FOLDER).collect()}
    assert out == {n: (len(x), len(x) != 2) for n, x in around.items()}


def test_components(spark, around):
    out = {r.node: r.label for r in catalogue.QUERIES["network_components"](spark, FOLDER).collect()}
    assert out == {n: min(g) for g in groups(around, around.get) for n in g}


def test_chains(spark, edges, around):
    meet = lambda e: {(min(n, x), max(n, x)) for n in e if len(around[n]) == 2 for x in around[n]}
    expected = Counter((len(g), min(a for a, _ in g), max(b for _, b in g)) for g in groups(edges, meet))
    assert Counter(map(tuple, catalogue.QUERIES["contig_chains"](spark, FOLDER).collect())) == expected


def test_rule_bindings(spark, parts):
    expected = {}
    for way, path in parts.items():
        found = [None if sum(s) % 19 == 0 else min(s) % 4 for s in path]
        runs = [c for k, c in enumerate(found) if k == 0 or found[k - 1] != c]
        names = "-".join(str(c) for c in runs if c is not None)
        if path:
            expected[way] = (names, "stale" if None in found else "exact" if len(runs) == 1 else "split")
    assert {r.way: (r.contigs, r.status) for r in catalogue.QUERIES["rule_bindings"](spark, FOLDER).collect()} == expected


def nearest(around, start, length):
    best, new = {start: 0}, {start}
    while new:
        tried = [(x, best[n] + length(n, x)) for n in new for x in around[n]]
        new = set()
        for x, to in tried:
            if to < best.get(x, to + 1):
                best[x] = to
                new.add(x)
    return best


def test_distances_of_the_queries(spark, around):
    start = min(around)
    assert {r.node: r.hops for r in catalogue.QUERIES["reachability"](spark, FOLDER).collect()} == nearest(around, start, lambda a, b: 1)
    assert {r.node: r.distance for r in catalogue.QUERIES["shortest_path"](spark, FOLDER).collect()} == nearest(around, start, lambda a, b: 1 + (a + b) % 5)


def test_distances_have_no_hop_limit(spark):
    """A ring with one dear shortcut: the nearest way to 9 has nine edges."""
    ring = [(k, k + 1, 1) for k in range(12)] + [(0, 9, 50)]
    e = spark.createDataFrame(ring, "a long, b long, length long")
    around = {n: {x for a, b, _ in ring for x in (a, b) if n in (a, b) and x != n} for n in range(13)}
    assert {r.node: r.hops for r in network.reachable(e, 0).collect()} == nearest(around, 0, lambda a, b: 1)
    assert {r.node: r.distance for r in network.shortest(e, 0).collect()} == {k: k for k in range(13)}
    assert {r.node: r.hops for r in network.reachable(e, 0, 2).collect()} == {0: 0, 1: 1, 9: 1, 2: 2, 8: 2, 10: 2}


def test_walks_over_the_whole_network(spark, around):
    rows = catalogue.QUERIES["plan_walks"](spark, FOLDER).collect()
    walks = {run: [n for r, _, n in sorted(rows) if r == run] for run in range(10)}
    for run, path in walks.items():
        steps = [(min(s), max(s)) for s in zip(path, path[1:])]
        assert path[0] == 3 * run and len(set(steps)) == len(steps)
        assert all(b in around[a] for a, b in zip(path, path[1:]))
        left = {x for x in around.get(path[-1], ()) if (min(x, path[-1]), max(x, path[-1])) not in steps}
        assert len(path) == 65 or not left


def test_walks_need_no_small_graph(spark):
    """Part keys past every former prefix; a goal ends a walk, a dead end too, and seeds give the same walk again."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    arcs = spark.range(200_001).selectExpr("id + 500000 AS a", "id + 500001 AS b", "1.0D AS length")
    runs = spark.createDataFrame([(1, 7, 500000, 500005), (2, 7, 700000, -1), (3, 7, 500000, -1)], "run long, seed long, start long, goal long")
    out = [sorted(map(tuple, routes.planned(runs, arcs, 8).collect())) for _ in range(2)]
    assert out[0] == out[1]
    walks = {run: [n for r, _, n in out[0] if r == run] for run in (1, 2, 3)}
    assert walks[1] == list(range(500000, 500006)) and walks[3] == list(range(500000, 500009))
    assert walks[2] in ([700000, 700001], list(range(700000, 699991, -1)))
