"""The route catalog: chosen routes by scenario, and each family of routes once."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import canonical, family_id, forward


def families(records: DataFrame, prefix: str = "route-family-") -> DataFrame:
    """Routes (scenario, route, nodes: array, quality, ...) with ``family`` and ``direction``: a path and its reverse are one family."""
    return records.withColumns({"family": family_id(F.col("nodes"), prefix), "direction": F.when(forward(F.col("nodes")), "forward").otherwise("reverse")})


def representatives(records: DataFrame) -> DataFrame:
    """The best route of each family by quality, ties to the lesser route; its nodes are in the family's own order."""
    best = records.withColumn("_k", F.row_number().over(W.partitionBy("family").orderBy(F.desc("quality"), "route"))).where("_k = 1").drop("_k")
    return best.withColumn("nodes", canonical(F.col("nodes")))


def scenarios(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(scenario, start, goal, is_loop, route_count, routes) of all pairs (start, goal), also of those without routes; routes by quality, best first."""
    named = pairs.withColumn("scenario", F.concat_ws("__to__", "start", "goal"))
    route = F.struct((-F.col("quality")).alias("_q"), F.col("route").alias("id"), F.col("family").alias("family_id"), "direction", "quality")
    held = records.groupBy("scenario").agg(F.transform(F.array_sort(F.collect_list(route)), lambda r: F.struct(r["id"].alias("id"), r["family_id"].alias("family_id"), r["direction"].alias("direction"), r["quality"].alias("quality_score"))).alias("routes"))
    out = named.join(held, "scenario", "left")
    return out.select("scenario", "start", "goal", (F.col("start") == F.col("goal")).alias("is_loop"), F.when(F.col("routes").isNull(), 0).otherwise(F.size("routes")).cast("long").alias("route_count"), F.coalesce("routes", F.array().cast(out.schema["routes"].dataType)).alias("routes"))


def write(pairs: DataFrame, records: DataFrame, path: str) -> None:
    """``path``/scenarios and ``path``/families as JSON lines, written by tasks; a catalog of any size passes no driver."""
    named = families(records)
    scenarios(pairs, named).write.mode("overwrite").json(f"{path}/scenarios")
    representatives(named).write.mode("overwrite").json(f"{path}/families")
