"""Canonical texts and digests against the standard library's, and configurations in force."""
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pathloom.plans import build
from pathloom.sources import variants

ODD = {"b": [1, 2.5, 0.0, 1e-5, 0.0001234, 1e16, 123456789012345.6, 1.5e300, 12345678.0, 35.0, 0.045, 1e7, -2e-7], "a": {"z": None, "é": "naïve 😀 \"q\" \\ \n\t\u0001\x7f", "": []}, "t": True, "n": {}, "u_1": "plain", "big": 9007199254740993}


def plain(document):
    return json.dumps(document, sort_keys=True, separators=(",", ":"))


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def rows_of(spark, documents):
    return variants.unfolded(variants.documents(spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False)) for k, d in documents.items()], "doc string, text string")))


def test_canonical(spark):
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return [rng.randrange(-5, 10**rng.randrange(1, 17)), rng.choice([-1, 1]) * math.exp(rng.uniform(-30, 60)), "".join(rng.choice("abé\"\\\n漢") for _ in range(rng.randrange(5))), rng.choice([True, False, None]), round(rng.uniform(-200, 200), 6)][kind]
        return [value(depth - 1) for _ in range(rng.randrange(12))] if kind == 5 else {f"k{rng.randrange(9)}": value(depth - 1) for _ in range(rng.randrange(5))}

    docs = {"odd": ODD, "scalar": 5, "empty": []} | {f"r{k}": value(4) for k in range(25)}
    found = {r.doc: r.text for r in variants.canonical(rows_of(spark, docs)).collect()}
    assert found == {k: plain(d) for k, d in docs.items()}


def test_a_number_is_formatted_once_for_each_width(spark):
    """Nested uses of a formatted text would double the work with each use."""
    assert str(variants._decimal(F.col("text"))).count("format_string") <= 3


def test_numbers_near_the_plain_form(spark):
    numbers = [0.1, 0.001, 0.00099, 0.0001, 0.00001, 0.1 + 0.2, 1 / 3, 100.0, 999999999999999.0, 9007199254740992.0, 1e15, 1e16, 123456789.125, 0.30000000000000004, 12345678901234.5, 9999999.5, 10000000.5, 1e-3, -0.5, -100.0, 2.0**60]
    found = {r.doc: r.text for r in variants.canonical(rows_of(spark, {str(k): [n] for k, n in enumerate(numbers)})).collect()}
    assert found == {str(k): plain([n]) for k, n in enumerate(numbers)}


def test_build(spark):
    docs = {
        "none": {}, "flat": {"beam_width": 3, "algorithms": ["beam"], "other": 1}, "sections": {"planner": {"beam_width": 4, "max_overlap_m": 70, "seed_start": 9}, "debug_catalog": {"seed_start": 2, "algorithms": ["x", "y"]}, "browser_runtime": {"browser_mcts_iterations": 7}}}
    rows = rows_of(spark, docs)
    force = {"none": build.DEFAULTS, "flat": build.DEFAULTS | {"beam_width": 3, "algorithms": ["beam"]}, "sections": None}
    digest = {r.doc: r.digest for r in build.build_digest(rows.where("doc <> 'sections'")).collect()}
    assert digest == {k: hashlib.sha1(plain(force[k]).encode()).hexdigest()[:12] for k in ("none", "flat")}
    told = {(r.doc, r.name): r.value for r in build.runtime_config(build.effective(rows)).collect()}
    assert told["sections", "mcts_iterations"] == 7 and told["none", "mcts_iterations"] == 320 and told["flat", "mcts_time_budget_ms"] == 350 and len(told) == 21
