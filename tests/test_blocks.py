"""Articulation points against taking each node away."""
import random

import pytest

from pathloom.operators import blocks


def parts(nodes, edges):
    left, n = set(nodes), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            at = todo.pop()
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == at and y in left:
                        left.remove(y)
                        todo.append(y)
    return n


@pytest.mark.parametrize("seed", range(2))
def test_against_removal(spark, seed):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(38)] + [(50, 51), (51, 52), (52, 50), (52, 53), (53, 54), (54, 52), (60, 60), (50, 51)]
    real = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    nodes = {n for e in real for n in e}
    whole = parts(nodes, real)
    expected = {n: parts(nodes - {n}, {e for e in real if n not in e}) > whole for n in nodes}
    found = {r.node: r for r in blocks.articulation(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: r.articulation for n, r in found.items()} == expected
    assert found[52].blocks == 2 and found[53].blocks == 1


def test_edges_are_stored_once(spark):
    """Of the tables that are stored, few have a row for each edge: no step stores the same edges again."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    stored = []

    def checkpoint(table):
        stored.append(table.checkpoint())
        return stored[-1]

    ring = [(k, (k + j) % 24) for k in range(24) for j in (1, 2, 3, 4, 5)]
    found = blocks.articulation(spark.createDataFrame(ring, "a long, b long"), checkpoint=checkpoint).collect()
    assert len(found) == 24 and all(r.blocks == 1 and not r.articulation for r in found)
    assert sum(t.count() == 120 for t in stored) == 1


def test_no_edges(spark):
    assert blocks.articulation(spark.createDataFrame([], "a long, b long")).isEmpty()
