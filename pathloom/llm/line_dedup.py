"""Line dedup by site-relative frequency. DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, staged, table, text_or_empty, without

#: A line on more than this share of a host's pages is boilerplate, if it is on MIN_PAGES pages at least: one page never makes its own line boilerplate.
MAX_RATIO, MIN_PAGES = 0.1, 2


#: What is cut from both ends of a line before it is compared, so that a line ends alike with and without a carriage return.
BLANK = " \t\x0b\x0c\r"


def _bare(line):
    return F.trim(line, F.lit(BLANK))


def _key(line):
    return F.xxhash64(_bare(line))


def _lines(col: str = "text"):
    return F.split(text_or_empty(col), "\n", -1)


def _site(host: str):
    """A name of the host that is never null: null is a host of its own, apart from the empty one."""
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("none")).alias("host")


def boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Lines (host: as _site names it, line_key, pages, host_pages) that are on more than ``max_ratio`` of their host's pages.

    A page counts a line once. Lines are compared without the white space at their ends; blank
    ones, of white space alone, are never boilerplate. Rows with a null host form a host of their own.
    """
    site = _site(host)
    keys = F.array_distinct(F.transform(F.filter(_lines(), lambda x: _bare(x) != ""), _key))
    pages = docs.groupBy(site).agg(F.count("*").alias("host_pages"))
    seen = docs.select(site, F.explode(keys).alias("line_key")).groupBy("host", "line_key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return seen.join(pages, "host").where(F.col("pages") > F.lit(float(max_ratio)) * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines of each host cut out of ``text``; adds n_lines and n_dropped.

    The lines that stay keep their order and their text. Null texts stay null with no lines.
    Rows are kept even when no line is left, repeated and null doc_ids included: a row is
    found again by a key of its own content, so equal rows get equal answers. Columns other
    than text pass through as they are; only columns called n_lines and n_dropped are replaced.
    """
    docs, back = aside(without(docs, "n_lines", "n_dropped"), "doc_id", "text", host.lower())
    return back(_dropped(docs, host.lower(), max_ratio, min_pages), "n_lines", "n_dropped")


def drop_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` without the boilerplate lines of each host, all other columns as they are."""
    docs, back = aside(docs, "doc_id", "text", host.lower())
    return back(_dropped(docs, host.lower(), MAX_RATIO, MIN_PAGES))


def _dropped(docs: DataFrame, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    bad = staged(boilerplate(docs, host, max_ratio, min_pages).select("host", "line_key"), "boilerplate")
    site = _site(host)
    row = F.xxhash64("doc_id", site, text_or_empty()).alias("_row")
    keys = F.array_distinct(F.transform(F.filter(_lines(), lambda x: _bare(x) != ""), _key))
    hits = (
        docs.select(row, site, F.explode(keys).alias("line_key"))
        .join(bad, ["host", "line_key"], "left_semi")
        .groupBy("_row").agg(F.collect_set("line_key").alias("_bad"))
    )
    lines = F.filter(_lines(), lambda x: ~F.coalesce(F.array_contains("_bad", _key(x)), F.lit(False)) | (_bare(x) == ""))
    out = docs.withColumn("_row", row).join(hits, "_row", "left")
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long"))
    out = out.withColumn("_kept", F.when(F.col("_bad").isNotNull(), lines))
    out = out.withColumn("n_dropped", F.coalesce(F.col("n_lines") - F.size("_kept"), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("_bad").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_dropped")))
    return out.withColumn("text", F.when(F.col("_bad").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))).drop("_row", "_bad", "_kept")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE_SQL = """
WITH r AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
l AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM r),
p AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
s AS (SELECT source, k, count(DISTINCT doc_id) AS pages FROM l WHERE k <> '' GROUP BY source, k),
b AS (SELECT s.source, s.k FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source WHERE pages >= 2 AND pages > 0.1e0 * host_pages),
m AS (SELECT l.doc_id, l.line, l.i, b.k IS NOT NULL AS bad FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS text
FROM m GROUP BY doc_id
"""
