"""The nearest node of points near and far, against trying all."""
import math
import random

from pathloom.operators import places


def metres(a, b):
    (x, y), (u, v) = ([math.radians(t) for t in p] for p in (a, b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_near_and_far(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(6)
    nodes = [(k, 36 + rng.random(), -1 - rng.random()) for k in range(300)] + [(1000 + k, rng.uniform(-180, 180), rng.uniform(-80, 80)) for k in range(40)] + [(5000, 179.9, 10.0), (5001, -179.9, -10.0), (7, 36.5, -1.5), (3, 36.5, -1.5)]
    nodes = list({k: (k, x, y) for k, x, y in nodes}.values())
    points = [(k, 36 + rng.random(), -1 - rng.random()) for k in range(20)] + [(100 + k, rng.uniform(-180, 180), rng.uniform(-89, 89)) for k in range(40)] + [(200, -179.95, 10.0), (201, 179.95, -10.0), (202, 36.5, -1.5), (203, 0.0, 90.0)]
    found = {r.id: r for r in places.nearest(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(nodes, "id long, lon double, lat double")).collect()}
    assert len(found) == len(points)
    for k, x, y in points:
        best = min(metres((x, y), (u, v)) for _, u, v in nodes)
        assert abs(found[k].distance_m - best) < 1e-3 and abs(metres((x, y), next((u, v) for n, u, v in nodes if n == found[k].node)) - best) < 1e-3
    assert found[202].node == 3
    none = places.nearest(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame([], "id long, lon double, lat double")).collect()
    assert len(none) == len(points) and all(r.node is None and r.distance_m is None for r in none)
