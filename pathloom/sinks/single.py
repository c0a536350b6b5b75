"""One JSON document from many rows: tasks write its parts, and a commit joins them in order."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_document(rows: DataFrame, path: str, order: list[str], text: str, head: str, tail: str) -> None:
    """Write ``head``, the texts of all rows in their order with commas between them, and ``tail`` as one file at ``path``.

    Rows are sorted by range, so that each task writes its own stretch of the list; ``order`` must tell all rows apart. The parts are then
    appended to each other as streams, byte for byte, and the file gets its name last: a reader sees the old document or the whole
    new one. Without rows the list is empty.
    """
    spark = rows.sparkSession
    first = rows.agg(F.min(F.struct(*order)).alias("m")).first().m
    here = F.struct(*order)
    lead = F.lit(False) if first is None else (here == F.struct(*(F.lit(v).cast(dict(rows.dtypes)[c]).alias(c) for c, v in zip(order, first, strict=True))))
    scratch = f"{path}.parts-{uuid.uuid4().hex}"
    rows.orderBy(*order).select(F.when(lead, F.col(text)).otherwise(F.concat(F.lit(","), F.col(text))).alias("value")).write.text(scratch)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    whole = jvm.org.apache.hadoop.fs.Path(f"{scratch}.whole")
    out = files.create(whole, True)
    try:
        out.write(bytearray(head.encode()))
        parts = sorted((s.getPath() for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(scratch)) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        for part in parts:
            source = files.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            finally:
                source.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    files.delete(at, False)
    if not files.rename(whole, at):
        raise OSError(f"could not name {path}")
    files.delete(jvm.org.apache.hadoop.fs.Path(scratch), True)


def feature_collection(features: DataFrame, path: str, order: list[str]) -> None:
    """A GeoJSON document of features (``feature``: JSON text)."""
    write_document(features, path, order, "feature", '{"type":"FeatureCollection","features":[', "]}")


def route_documents(routes: DataFrame, steps: DataFrame, keep: int = 5) -> DataFrame:
    """(run, document) of each run's routes as JSON, by rank: lengths and score to millimetres, with their steps.

    ``routes`` is (run, rank, algorithm, contigs, nodes, total, distinct_length, overlap, score, complete), ``steps`` (run, rank, pos, contig_id, from_node_id, to_node_id, reused, length_m).
    """
    own = steps.groupBy("run", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "contig_id", "from_node_id", "to_node_id", "reused", "length_m"))), lambda x: F.struct(*(x[c].alias(c) for c in ("contig_id", "from_node_id", "to_node_id", "reused", "length_m")))).alias("steps"))
    mm = lambda c, name: F.round(c, 3).alias(name)
    again = F.filter(F.array_distinct("contigs"), lambda c: F.size(F.filter("contigs", lambda x: x == c)) > 1)
    one = routes.where(F.col("rank") <= keep).join(own, ["run", "rank"], "left").select(
        "run", "rank", F.struct("algorithm", "complete", mm("score", "score"), mm("total", "total_length_m"), mm("distinct_length", "unique_length_m"), mm("overlap", "overlap_length_m"), F.element_at("nodes", -1).alias("terminal_node_id"),
                                F.col("contigs").alias("contig_id_sequence"), again.alias("repeated_contig_ids"), F.col("nodes").alias("route_node_ids"), "steps").alias("route"))
    listed = one.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "route"))), lambda x: x["route"]).alias("routes"))
    return listed.select("run", F.to_json(F.struct("routes")).alias("document"))
