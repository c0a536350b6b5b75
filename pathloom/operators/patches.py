"""Ordered edits of ways: add, remove, retag, replace geometry. Each way folds its own edits, so edits of different ways never meet."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import short_digest

#: The operations; the last leaves the map as it is.
ADD, REMOVE, RETAG, REPLACE, OTHER = "add_way", "remove_way", "update_way_tags", "replace_way_geometry", "update_contig_tags"
_TAGS = "map<string,string>"


def violations(patches: DataFrame) -> DataFrame:
    """(id, problem) of patches that repeat an id, or have an operation that is not known."""
    twice = patches.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    odd = patches.where(F.col("enabled") & ~F.col("op").isin(ADD, REMOVE, RETAG, REPLACE, OTHER)).select("id", F.lit("unsupported operation").alias("problem"))
    return twice.unionByName(odd)


def moved_nodes(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Ids that patches or the map give two places; nodes may be added only if this is empty."""
    new = patches.where("enabled").select(F.explode("new_nodes").alias("n")).select("n.id", "n.lon", "n.lat")
    return nodes.select("id", "lon", "lat").unionByName(new).groupBy("id").agg(F.countDistinct("lon", "lat").alias("places")).where("places > 1").select("id")


def with_nodes(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """The map's nodes and those of enabled patches, each once."""
    new = patches.where("enabled").select(F.explode("new_nodes").alias("n")).select("n.id", "n.lon", "n.lat")
    return nodes.select("id", "lon", "lat").unionByName(new).dropDuplicates(["id"])


def applied(ways: DataFrame, patches: DataFrame) -> DataFrame:
    """(way, nodes, tags, problem) after the enabled patches in the order of ``ord``.

    ``ways`` is (way, nodes, tags); ``patches`` (ord, id, enabled, op, way, nodes, tags, set, remove). A patch that does
    not fit (adding a way that is there, or touching one that is not) is left out and named in ``problem``, the first of a
    way only; ways without a problem have null there. Ways that are gone have a row only if they have a problem.
    """
    asked = patches.where(F.col("enabled") & (F.col("op") != OTHER)).groupBy("way").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "op", "nodes", F.map_entries("tags").alias("tags"), F.map_entries("set").alias("set"), "remove"))).alias("edits"))
    both = ways.select("way", F.col("nodes").alias("n"), F.col("tags").alias("t")).join(asked, "way", "full")
    no_tags, none = F.map_from_arrays(F.array(), F.array()).cast(_TAGS), F.lit(None).cast("string")
    state = F.struct(F.col("n").isNotNull().alias("there"), F.col("n").alias("nodes"), F.coalesce("t", no_tags).alias("tags"), none.alias("problem"))

    def edit(s, e):
        op = e["op"]
        bad = F.when(op == ADD, s["there"]).otherwise(~s["there"])
        given = lambda name: F.coalesce(F.map_from_entries(e[name]), no_tags)
        gone = F.array_union(F.coalesce(e["remove"], F.array().cast("array<string>")), F.map_keys(given("set")))
        retagged = F.map_concat(F.map_filter(s["tags"], lambda k, v: ~F.array_contains(gone, k)), given("set"))
        return F.struct(
            F.when(bad, s["there"]).otherwise(op != REMOVE).alias("there"),
            F.when(bad, s["nodes"]).when(op.isin(ADD, REPLACE), e["nodes"]).otherwise(s["nodes"]).alias("nodes"),
            F.when(bad, s["tags"]).when(op == ADD, given("tags")).when(op == RETAG, retagged).otherwise(s["tags"]).alias("tags"),
            F.coalesce(s["problem"], F.when(bad, F.concat(e["id"], F.when(op == ADD, ": way exists").otherwise(": way is missing")))).alias("problem"))

    out = both.withColumn("s", F.when(F.col("edits").isNull(), state).otherwise(F.aggregate("edits", state, edit))).where("s.there OR s.problem IS NOT NULL")
    return out.select("way", F.when(F.col("s.there"), F.col("s.nodes")).alias("nodes"), F.when(F.col("s.there"), F.col("s.tags")).alias("tags"), "s.problem")


def digest(patches: DataFrame, settings: str) -> DataFrame:
    """One row (ids, digest): the enabled patches in order, and a digest of them and ``settings``, a canonical text. The patches of one set are a curated list."""
    done = patches.where(F.col("enabled") & (F.col("op") != OTHER))
    fields = [F.array_sort(F.map_entries(c)).alias(c) if isinstance(patches.schema[c].dataType, type(patches.schema["tags"].dataType)) else F.col(c) for c in sorted(patches.columns)]
    listed = done.select("ord", "id", F.to_json(F.struct(*fields)).alias("j")).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "j"))).alias("s"))
    return listed.select(F.transform("s", lambda x: x["id"]).alias("ids"), short_digest(F.concat(F.lit(settings), F.array_join(F.transform("s", lambda x: x["j"]), ","))).alias("digest"))
