"""Build configurations as rows of paths: defaults, sections, what a planner gets of them, and the digest of what is in force."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import short_digest
from ..sources.variants import ROW, canonical, documents, unfolded
from .contracts import SECTIONS

#: What a configuration has where a document says nothing.
DEFAULTS = {
    "algorithms": ["mcts", "beam", "naive"], "seed_start": 1, "seed_end": 6, "candidate_limit_per_run": 2, "routes_per_scenario": 12, "selection_window": 36,
    "short_connector_max_length_m": 35.0, "max_overlap_m": 70.0, "max_steps": 256, "random_top_k": 4, "end_stop_probability": 0.7, "end_stop_unused_slack_m": 400.0, "end_finish_unused_slack_m": 250.0,
    "future_length_weight": 0.08, "connector_length_weight": 0.02, "overlap_penalty_per_m": 12.0, "articulation_penalty": 45.0, "articulation_future_threshold_m": 400.0, "dead_end_penalty": 180.0,
    "early_finish_penalty": 320.0, "rollout_trials": 250, "keep_best": 5, "beam_width": 80, "beam_branch_factor": 5, "beam_rounds": 200, "beam_selection_pool": 5, "beam_selection_window": 12,
    "browser_selection_pool": 5, "browser_selection_window": 12, "browser_mcts_iterations": 320, "browser_mcts_rollout_top_k": 3, "browser_mcts_rollout_samples": 2, "browser_mcts_time_budget_ms": 350.0,
    "browser_mcts_progress_interval_iterations": 24, "mcts_iterations": 640, "mcts_exploration_weight": 1.0, "mcts_rollout_top_k": 3, "mcts_rollout_samples": 3, "mcts_prior_weight": 0.5,
    "mcts_loop_completion_bonus": 220.0, "mcts_loop_unused_penalty_per_m": 0.045, "mcts_loop_late_return_bonus": 180.0, "mcts_loop_overlap_penalty_per_m": 4.0, "elevation_profile_spacing_m": 60.0,
    "elevation_smoothing_window": 3, "elevation_min_step_m": 0.5,
}
#: Fixed names of the fields that a page's planner gets under a name of its own.
RUNTIME = ("selection_pool", "selection_window", "mcts_iterations", "mcts_rollout_top_k", "mcts_rollout_samples", "mcts_time_budget_ms", "mcts_progress_interval_iterations")


def effective(rows: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Unfolded configurations (``variants.unfolded``) as flat ones: sections taken away, unknown keys left out, defaults where a document has nothing.

    A document with a section counts as one of sections, and other keys at its top are left out; else its keys are flat already.
    """
    spark: SparkSession = rows.sparkSession
    defaults = DEFAULTS if defaults is None else defaults
    own = unfolded(documents(spark.createDataFrame([("", json.dumps(defaults))], "doc string, text string"))).drop("doc")
    section = "|".join(SECTIONS)
    parts = rows.withColumn("_s", F.regexp_extract("path", rf"^\$\.({section})(?=$|[.\[])", 1))
    sectioned = parts.where("_s <> ''").select("doc").distinct().withColumn("_in", F.lit(True))
    parts = parts.join(sectioned, "doc", "left").where((F.col("_in").isNull() | (F.col("_s") != "")) & ~F.col("place").isin("$", *(f"$.{s}" for s in SECTIONS)))
    bare = lambda c: F.regexp_replace(c, rf"^\$\.({section})(?=$|[.\[])", r"\$").alias(c)
    flat = parts.select("doc", *(bare(c) if c in ("path", "place", "above", "above_place") else F.col(c) for c in ROW if c != "doc"))
    top = lambda c: F.regexp_extract(c, r"^\$\.([A-Za-z0-9_]+)", 1)
    flat = flat.withColumn("_key", top("path")).where(F.col("_key").isin(*defaults)).drop("_s")
    docs = rows.select("doc").distinct()
    given = flat.select("doc", "_key").distinct()
    # The defaults are a fixed list: they are sent to every task.
    filled = docs.join(F.broadcast(own.withColumn("_key", top("path")))).join(given, ["doc", "_key"], "left_anti")
    return flat.select(*ROW).unionByName(filled.select(*ROW))


def build_digest(rows: DataFrame) -> DataFrame:
    """(doc, digest) of what is in force in each configuration."""
    return canonical(effective(rows)).select("doc", short_digest(F.col("text")).alias("digest"))


def runtime_config(flat: DataFrame) -> DataFrame:
    """(doc, name, value) that a page's planner gets of flat configurations: the fields of RUNTIME without their prefix, as numbers."""
    named = {f"browser_{n}": n for n in RUNTIME}
    kept = flat.where(F.col("key").isin(*named))
    return kept.select("doc", F.expr("substring(key, 9)").alias("name"), F.col("text").try_cast("double").alias("value"))
