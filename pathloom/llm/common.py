"""What the corpus operators share: table access, the shared work folder, and stage tables.

Stage tables are the recovery points: they are written to the folder that the
cluster names in ``spark.checkpoint.dir``, so a lost executor costs a re-read and
never a recomputation of the stages before.
"""
from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts fix it.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the session's ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def lean_shuffles(spark: SparkSession):
    """While it holds, Spark removes a query's shuffle files when the query ends: the stage tables replace them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str = "t", compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Write ``df`` as a stage table, partitioned ``by`` a column if given, and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    with lean_shuffles(spark):
        df.write.parquet(path, compression=compression, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that no later plan reads."""
    for t in tables:
        remove(t.sparkSession, t.stage_path)


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder, if it is there, through the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the columns of these names, in any case of letters."""
    return docs.select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in names))


def aside(docs: DataFrame, *needed: str):
    """``docs`` with every column but the ``needed`` ones under a name that no operator uses, and what turns its columns back to theirs.

    So an operator's own columns never meet those of the caller, whatever these are called, in any case of letters.
    """
    names = docs.columns
    own = [c.lower() if c.lower() in needed else f"other{k}" for k, c in enumerate(names)]
    return docs.toDF(*own), lambda df, *more: df.select(*own, *more).toDF(*names, *more)


def row_key():
    """A 64-bit key of a row's doc_id and text; doc_ids may be null or repeat."""
    return F.xxhash64("doc_id", text_or_empty())
