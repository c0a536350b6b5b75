"""All pairs of places by all planners and seeds: a table of runs that is planned in lots, noted as finished, and taken up again after a stop."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.paths import there
from .planning import RESULT, Rules
from .rollouts import rollouts
from .search import beam
from .tree_search import tree_search

#: Each takes (runs, arcs, rules, and what is its own) and returns the best routes of each run.
PLANNERS: dict[str, Callable[..., DataFrame]] = {
    "naive": lambda runs, arcs, rules, **own: rollouts(runs, arcs, rules=rules, **own),
    "beam": lambda runs, arcs, rules, **own: beam(runs, arcs, rules=rules, **own),
    "mcts": lambda runs, arcs, rules, **own: tree_search(runs, arcs, rules=rules, **own),
}


def planner_of(name: str) -> Callable[..., DataFrame]:
    if name not in PLANNERS:
        raise KeyError(name)
    return PLANNERS[name]


def work(places: DataFrame, seeds: int) -> DataFrame:
    """(run, scenario, start, goal, seed) of every ordered pair of places (place, node) with itself and all others, for seeds 1 to ``seeds``.

    Runs are numbered by a digest of scenario and seed, so a run keeps its number when places are added.
    """
    one, two = places.select(F.col("place").alias("a"), F.col("node").alias("start")), places.select(F.col("place").alias("b"), F.col("node").alias("goal"))
    pairs = one.crossJoin(two)  # every pair is a scenario: the result is this large
    named = pairs.select(F.concat_ws("__", "a", "b").alias("scenario"), "start", "goal", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    return named.withColumn("run", F.xxhash64("scenario", "seed"))


def planned(runs: DataFrame, arcs: DataFrame, folder: str, planners: dict[str, dict], lots: int = 1, rules: Rules = Rules(), found: Callable[[str, int], None] = lambda planner, lot: None) -> DataFrame:
    """(planner, lot, scenario, seed, run, rank, ...): the routes of all ``runs`` by all ``planners`` (name: its own settings).

    Runs go in ``lots`` by a hash, each lot of a planner into a folder of its own under ``folder``. A lot that is there whole is not planned
    again, so a stopped campaign goes on where it was; one that was cut off is planned anew. The lots' routes are those
    of an uninterrupted campaign, since draws depend on run and seed alone. ``found`` is told of each lot that was planned.
    """
    spark = runs.sparkSession
    for name, own in planners.items():
        plan = planner_of(name)
        for lot in range(lots):
            path = f"{folder}/{name}/{lot}"
            if there(spark, f"{path}/_SUCCESS"):
                continue
            some = runs.where(F.pmod("run", F.lit(lots)) == lot)
            plan(some, arcs, rules, **own).select(*RESULT).join(some.select("run", "scenario", "seed"), "run").write.mode("overwrite").parquet(path)
            found(name, lot)
    parts = [spark.read.parquet(f"{folder}/{name}/{lot}").withColumns({"planner": F.lit(name), "lot": F.lit(lot)}) for name in planners for lot in range(lots)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("planner", "lot", "scenario", "seed", *RESULT)
