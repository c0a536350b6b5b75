"""Canonical texts written where documents lie: those of the standard library, with nothing stored but what is kept."""
import json
import math
import random

from pathloom.functions.ids import short_digest
from pathloom.sources import variants


def plain(document):
    return json.dumps(document, sort_keys=True, separators=(",", ":"))


def test_texts_of_shallow_and_deep_documents(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(8)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return [rng.randrange(-5, 10**rng.randrange(1, 17)), rng.choice([-1, 1]) * math.exp(rng.uniform(-30, 60)), "".join(rng.choice("abé\"\\\n漢") for _ in range(rng.randrange(5))), rng.choice([True, False, None]), round(rng.uniform(-200, 200), 6)][kind]
        return [value(depth - 1) for _ in range(rng.randrange(12))] if kind == 5 else {f"k{rng.randrange(9)}": value(depth - 1) for _ in range(rng.randrange(5))}

    docs = {"scalar": 5, "null": None, "empty": [], "object": {}, "odd": {"b": [1, 2.5, 0.0, 1e-5, 1e16, []], "a": {"é": "naïve 😀 \"q\" \\ \n", "": {}}}} | {f"r{k}": value(4) for k in range(40)}
    docs |= {f"deep{k}": [{"x": [[[k, {"y": {"z": [0.5]}}]]]}] for k in range(3)} | {"edge": [[[[[]]]]], "over": [[[[[1]]]]]}
    frame = spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False)) for k, d in docs.items()] + [("bad", "{")], "doc string, text string")
    made = []

    def kept(df):
        made.append(df.checkpoint())
        return made[-1]

    found = {r.doc: r.text for r in variants.texts(variants.documents(frame), checkpoint=kept).collect()}
    assert found == {k: plain(d) for k, d in docs.items()} | {"bad": "null"}
    assert {r.doc for r in made[0].where("value IS NOT NULL").collect()} == {"deep0", "deep1", "deep2", "over"}


def test_shallow_documents_store_their_digests_alone(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    made = []
    frame = spark.createDataFrame([(k, f'{{"seed":{k},"steps":[{{"contig_id":{k},"length_m":1.5}}]}}') for k in range(30)], "doc long, text string")
    out = variants.texts(variants.documents(frame), short_digest, lambda df: made.append(df.checkpoint()) or made[-1])
    assert len(made) == 1 and {len(r.text) for r in made[0].collect()} == {12} and "Exchange" not in made[0]._jdf.queryExecution().toString()
    assert len({r.text for r in out.collect()}) == 30
