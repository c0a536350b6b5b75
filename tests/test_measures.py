"""Rewards, values of tree nodes, seeded numbers and polylines, against plain arithmetic."""
import math

import pytest
from pyspark.sql import functions as F

from pathloom.functions import draws, policy, text
from pathloom.operators import measures


def test_rewards_and_values(spark):
    rows = [(300.0, True, 200.0, 10.0, 50.0, 0, 0.0, 5, None), (300.0, False, 200.0, 10.0, 50.0, 4, 1.2, 9, 80.0), (0.0, True, 0.0, 0.0, 0.0, 1, -0.5, 0, None)]
    df = spark.createDataFrame(rows, "score double, closed boolean, d double, o double, ahead double, visits long, total double, parent long, move double")
    c = F.col
    got = df.select(measures.reward(c("score"), c("closed"), c("d"), c("o"), c("ahead")), measures.node_value(c("visits"), c("total"), c("parent"), c("move"))).collect()
    for (score, closed, d, o, ahead, n, total, parent, move), (worth, value) in zip(rows, got, strict=True):
        assert worth == pytest.approx((score + (220 + 180 * d / max(1, d + ahead) - 0.045 * ahead - 4 * o if closed else 0)) / 1000)
        assert value == (math.inf if not n else pytest.approx(total / n + math.sqrt(math.log(max(1, parent)) / n) + (0.5 * move / 1000 if move else 0)))


def test_polyline(spark):
    known = [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]  # the example of the format's public description
    df = spark.createDataFrame([([*known],), ([],)], "p array<struct<lon:double,lat:double>>")
    assert [r[0] for r in df.select(text.polyline(F.col("p"))).collect()] == ["_p~iF~ps|U_ulLnnqC_mqNvxq`@", ""]


def test_seeded(spark):
    df = spark.range(0, 200).select((F.col("id") * 40_000_003).alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"))
    got = [r[0] for r in df.select(draws.seeded(F.col("seed"), F.col("k"))).collect()]
    assert all(0 <= x < 1 for x in got) and abs(sum(got) / len(got) - 0.5) < 0.02 and len(set(got)) == len(got)


def test_oriented_raises(spark):
    df = spark.createDataFrame([([1, 2, 3], 1, 2)], "n array<long>, a long, b long")
    with pytest.raises(Exception, match="do not match"):
        df.select(measures.oriented(F.col("n"), F.lit(False), F.col("a"), F.col("b"))).collect()


def test_problems_of_tag_patches_and_areas(spark):
    put = [{"local:bikeability": "7"}, {"local:availability": "closed"}, {"local:routing_state": "default", "local:bikeability": "5"}, {"local:unavailable_until": "2030-02-30"}, {"local:bicycle_direction": "up"}]
    df = spark.createDataFrame([(p,) for p in put], "t map<string,string>")
    rules = policy.tag_patch_problems(F.col("t"))
    found = df.select(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).collect()
    assert [[x.split()[0] for x in r[0]] for r in found] == [["bikeability"], ["availability"], [], ["unavailable_until"], ["bicycle_direction"]]
    areas = spark.createDataFrame([({"local:boundary_refs": "r1,,w2"}, ["w2"]), ({"local:boundary_refs": ""}, ["w2"]), ({}, []), ({"x": "y"}, None)], "t map<string,string>, r array<string>")
    assert [r[0] for r in areas.select(policy.touches(F.col("t"), F.col("r"))).collect()] == [True, False, True, True]
