"""Planner progress as a stream: the best value so far for each key."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.inputs import shared_folder


def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, best, n) from a file stream of events, drained with the availableNow trigger into a table."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    state = events.groupBy("user_id").agg(F.max("value").alias("best"), F.count("*").alias("n"))
    where = f"{shared_folder(spark)}/progress_{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/state")

    running = state.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(state.schema).parquet(f"{where}/state")
