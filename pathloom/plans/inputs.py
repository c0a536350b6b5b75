"""The driver's tables seen as map data. The same projections in Spark and, as SQL text, in the twins."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Iterative operators cut their lineage in the session's checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


#: Bytes of a table's files for each task that sorts or groups them.
SHARE = 2 << 20


def tasks(spark: SparkSession, d: str, name: str) -> int | None:
    """How many tasks a table's size asks for, so that the share of each does not grow with the table; none if it is not more than Spark's own number."""
    n = -(-int(str(table(spark, d, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SHARE)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``rows`` by keys over ``n`` tasks, if given."""
    return rows.repartition(n, *keys) if n else rows


def geo_nodes(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (F.lit(36.79) + (k % 61) / 1000.0).alias("lon"), (F.lit(-1.26) + ((k - k % 61) / 61) / 1000.0).alias("lat"), (F.lit(1600.0) + F.col("p_size")).alias("elevation"))


def geo_ways(spark, d) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), tasks(spark, d, "lineitem"), "l_orderkey")
    return lines.select(F.col("l_orderkey").alias("way"), F.row_number().over(w).cast("long").alias("pos"), F.col("l_partkey").alias("node"))


def steps(spark, d) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    whole = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lines = dealt(whole, tasks(spark, d, "lineitem"), "l_orderkey").select("l_orderkey", F.row_number().over(w).cast("long").alias("pos"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("length"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("scenario"), (F.col("o_orderstatus") == "F").alias("complete"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("scenario", F.col("l_orderkey").alias("run"), "pos", "item", "length", "complete")


def rings(spark, d) -> DataFrame:
    """Ring edges of a skewed quadrilateral for each region."""
    k = F.col("r_regionkey")
    lon, lat = F.lit(36.79) + k * 0.012, F.lit(-1.26) + k * 0.004
    corners = [(lon, lat), (lon + 0.011, lat + 0.003), (lon + 0.009, lat + 0.018), (lon + 0.001, lat + 0.015)]
    edges = F.array(*[F.struct(a[0].alias("lon1"), a[1].alias("lat1"), b[0].alias("lon2"), b[1].alias("lat2")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])
    return table(spark, d, "region").select(k.alias("area"), F.explode(edges).alias("e")).select("area", "e.*")


NODES = "SELECT p_partkey AS id, 36.79e0 + (p_partkey % 61) / 1000e0 AS lon, -1.26e0 + ((p_partkey - p_partkey % 61) / 61e0) / 1000e0 AS lat, 1600e0 + p_size AS elevation FROM part"
WAYS = "SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, l_partkey AS node FROM lineitem"
STEPS = "SELECT o_custkey AS scenario, l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos, l_partkey AS item, l_quantity AS length, o_orderstatus = 'F' AS complete FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_C = "SELECT r_regionkey AS area, 36.79e0 + r_regionkey * 0.012e0 AS x, -1.26e0 + r_regionkey * 0.004e0 AS y FROM region"
RINGS = " UNION ALL ".join(
    f"SELECT area, x + {a}e0 AS lon1, y + {b}e0 AS lat1, x + {c}e0 AS lon2, y + {e}e0 AS lat2 FROM ({_C})"
    for a, b, c, e in ((0, 0, 0.011, 0.003), (0.011, 0.003, 0.009, 0.018), (0.009, 0.018, 0.001, 0.015), (0.001, 0.015, 0, 0))
)
SEGMENTS = "SELECT way, pos, a, b FROM (SELECT way, pos, node AS a, lead(node) OVER (PARTITION BY way ORDER BY pos) AS b FROM ({ways})) WHERE b IS NOT NULL AND a <> b"
HAVERSINE = "2 * 6371000e0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"
