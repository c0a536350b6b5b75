"""A campaign that is stopped and taken up again; documents that are one file."""
import json

import pytest
from pyspark.sql import functions as F

from pathloom.operators import campaign, planning
from pathloom.sinks import single

EDGES = [(10, 1, 2, 100), (20, 2, 3, 120), (30, 1, 3, 30)]


def test_stop_and_resume(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    arcs = spark.createDataFrame([(x, y, c, float(m)) for c, a, b, m in EDGES for x, y in ((a, b), (b, a))], "at long, to long, contig long, length_m double")
    runs = campaign.work(spark.createDataFrame([("west", 1), ("east", 3)], "place string, node long"), 2).persist()
    assert sorted((r.scenario, r.seed) for r in runs.collect()) == sorted((f"{a}__{b}", s) for a in ("west", "east") for b in ("west", "east") for s in (1, 2))
    how, rules = {"naive": {"trials": 2}, "beam": {"width": 2, "branch": 2, "rounds": 4}}, planning.Rules(keep=2, steps=4)
    done = []

    def stops(planner, lot):
        done.append((planner, lot))
        if len(done) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        campaign.planned(runs, arcs, f"{tmp_path}/cut", how, 2, rules, stops)
    (tmp_path / "cut/beam/0").mkdir(parents=True)  # a lot that was begun and is not whole
    again = []
    cut = campaign.planned(runs, arcs, f"{tmp_path}/cut", how, 2, rules, lambda *x: again.append(x))
    assert done == [("naive", 0), ("naive", 1)] and again == [("beam", 0), ("beam", 1)]
    whole = campaign.planned(runs, arcs, f"{tmp_path}/whole", {"beam": how["beam"]}, 2, rules)
    same = lambda df: sorted(map(str, df.where("planner = 'beam'").collect()))
    assert same(cut) == same(whole) and cut.select("scenario", "seed", "planner").distinct().count() == 16 and cut.where("NOT complete").count() == 0
    with pytest.raises(KeyError):
        campaign.planner_of("other")


def test_one_document(spark, tmp_path):
    features = spark.range(1000).repartition(7).select(F.col("id"), F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id").alias("n"), F.lit("é,\"").alias("t"))).alias("feature"))
    path = f"{tmp_path}/all.geojson"
    for _ in range(2):
        single.feature_collection(features, path, ["id"])
        found = json.loads(open(path, encoding="utf-8").read())
        assert [f["n"] for f in found["features"]] == list(range(1000)) and found["features"][3]["t"] == 'é,"'
    single.feature_collection(features.limit(0), path, ["id"])
    assert json.loads(open(path).read()) == {"type": "FeatureCollection", "features": []} and [p.name for p in tmp_path.iterdir() if "parts" in p.name and not p.name.startswith(".")] == []


def test_route_documents(spark):
    routes = spark.createDataFrame([(1, 2, "beam", [10, 20, 10], [1, 2, 3, 2], 1.23456, 1.0, 0.2, -5.55555, False), (1, 1, "beam", [30], [1, 3], 30.0, 30.0, 0.0, 280.0, True), (1, 9, "beam", [10], [1, 2], 1.0, 1.0, 0.0, 1.0, False)], "run long, rank int, algorithm string, contigs array<long>, nodes array<long>, total double, distinct_length double, overlap double, score double, complete boolean")
    steps = spark.createDataFrame([(1, 1, 0, 30, 1, 3, False, 30.0)], "run long, rank int, pos int, contig_id long, from_node_id long, to_node_id long, reused boolean, length_m double")
    out = json.loads(single.route_documents(routes, steps).first().document)["routes"]
    assert [r["contig_id_sequence"] for r in out] == [[30], [10, 20, 10]] and out[0]["steps"] == [{"contig_id": 30, "from_node_id": 1, "to_node_id": 3, "reused": False, "length_m": 30.0}]
    assert out[1]["repeated_contig_ids"] == [10] and out[1]["total_length_m"] == 1.235 and out[1]["terminal_node_id"] == 2 and out[0]["score"] == 280.0
