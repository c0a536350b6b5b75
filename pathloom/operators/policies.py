"""Rules that select paths, brought onto edges and contigs. Selectors are edges along a path: (id, way_ids, pos, a, b) with a < b."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import canonical


def selected(selectors: DataFrame) -> DataFrame:
    """(a, b, way_ids): the edges that any rule selects, with all ways that it selects them of."""
    return selectors.groupBy("a", "b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("way_ids")))).alias("way_ids"))


def selector_faults(selectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, pos, problem) of selected edges that are not there, or that are of none of the rule's ways; edges are (a, b, ways)."""
    found = selectors.join(edges.select("a", "b", "ways"), ["a", "b"], "left")
    problem = F.when(F.col("ways").isNull(), "edge is missing").when(~F.arrays_overlap("way_ids", "ways"), "edge is of other ways")
    return found.select("id", "pos", problem.alias("problem")).where("problem IS NOT NULL")


def tag_entries(rows: DataFrame, keys: list[str], tags: str = "tags") -> DataFrame:
    """(keys, key, values): each tag of each key once, with the values that it is given."""
    return rows.select(*keys, F.explode(tags).alias("key", "value")).groupBy(*keys, "key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def merged_tags(rows: DataFrame, keys: list[str], tags: str = "tags") -> DataFrame:
    """(keys, tags, conflicts): the union of maps; tags that are given different values are in ``conflicts`` and not in ``tags``."""
    entries = tag_entries(rows, keys, tags).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("key", "values"))).alias("e"))
    one = F.filter("e", lambda x: F.size(x["values"]) == 1)
    return entries.select(*keys, F.map_from_entries(F.transform(one, lambda x: F.struct(x["key"], x["values"][0]))).alias("tags"), F.transform(F.filter("e", lambda x: F.size(x["values"]) > 1), lambda x: x["key"]).alias("conflicts"))


def onto_edges(selectors: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, tags, conflicts) of every edge (a, b, tags) with the tags of the rules (id, tags) that select it."""
    given = selectors.join(rules.select("id", "tags"), "id").select("a", "b", "tags")
    both = edges.select("a", "b", "tags", F.lit(1).alias("_n")).unionByName(given.withColumn("_n", F.lit(0)))
    # Edges and what rules say of them meet once: equal tags of an edge are one, and a key that stands there twice has different values.
    met = both.groupBy("a", "b").agg(F.flatten(F.collect_set(F.map_entries("tags"))).alias("_e"), F.sum("_n").cast("int").alias("_n")).where("_n > 0")
    met = met.withColumn("_e", F.array_sort(F.array_distinct(F.filter("_e", lambda x: x["value"].isNotNull()))))
    uses = lambda x: F.size(F.filter("_e", lambda y: y["key"] == x["key"]))
    tags, conflicts = F.map_from_entries(F.filter("_e", lambda x: uses(x) == 1)), F.array_distinct(F.transform(F.filter("_e", lambda x: uses(x) > 1), lambda x: x["key"]))
    return met.select("a", "b", tags.alias("tags"), conflicts.alias("conflicts"), F.explode(F.array_repeat(F.lit(1), F.col("_n"))).alias("_n")).drop("_n")


def signature(tags: Column) -> Column:
    """Tags as one comparable text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def uneven(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose rows (key, tags) differ in their tags: a contig may hold one policy only."""
    return rows.groupBy(key).agg(F.countDistinct(signature(F.col("tags"))).alias("kinds")).where("kinds > 1").select(key, "kinds")


def by_path(paths: DataFrame, known: DataFrame) -> DataFrame:
    """(id, match, direction) of paths (id, nodes, way_ids) among known ones (match, nodes, way_ids): the same nodes either way round, and the same ways.

    A path that has no match has nulls; one that has more has a row for each, and ``matches`` counts them.
    """
    key = lambda df: df.withColumn("_k", canonical(F.col("nodes"))).withColumn("_w", F.array_sort(F.array_distinct("way_ids")))
    k = key(known).select("_k", "_w", F.col("nodes").alias("_n"), "match")
    out = key(paths).join(k, ["_k", "_w"], "left")
    way = F.when(F.col("_n") == F.col("nodes"), "forward").when(F.col("_n").isNotNull(), "reverse")
    return out.select("id", "match", way.alias("direction"), F.count("match").over(W.partitionBy("id")).alias("matches"))


def bound(selectors: DataFrame, contig_edges: DataFrame) -> DataFrame:
    """(id, contigs, status) of rules along contigs, given the edges of those as (a, b, contig, place, size: edges of the contig).

    Contigs are in the order of the rule's path, runs as one. ``exact``: one contig as a whole in its own direction;
    ``reversed``: against it; ``split_across_contigs``: all else; ``stale``: an edge has no contig.
    """
    found = selectors.select("id", "pos", "a", "b").join(contig_edges, ["a", "b"], "left")
    order = W.partitionBy("id").orderBy("pos")
    new = ~F.col("contig").eqNullSafe(F.lag("contig").over(order)) | (F.row_number().over(order) == 1)
    g = found.withColumn("_new", new).groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_new") & F.col("contig").isNotNull(), F.struct("pos", "contig")))).alias("s"), F.count("*").alias("n"), F.max(F.col("contig").isNull()).alias("stale"), F.max("size").alias("size"),
        F.min_by("place", "pos").alias("first"), F.max_by("place", "pos").alias("last"))
    whole = (F.size("s") == 1) & (F.col("n") == F.col("size"))
    status = F.when(F.col("stale"), "stale").when(whole & (F.col("first") <= F.col("last")), "exact").when(whole, "reversed").otherwise("split_across_contigs")
    return g.select("id", F.transform("s", lambda x: x["contig"]).alias("contigs"), status.alias("status"))


def edited(policies: DataFrame, edits: DataFrame) -> DataFrame:
    """Policies (contig, policy) after edits (ord, contig, policy): the last of a contig counts, and an empty or null one clears it."""
    last = edits.groupBy("contig").agg(F.max_by(F.struct("policy"), "ord").alias("e"))
    both = policies.join(last, "contig", "full").select("contig", F.when(F.col("e").isNotNull(), F.col("e.policy")).otherwise(F.col("policy")).alias("policy"))
    return both.where("policy IS NOT NULL AND size(policy) > 0")


def regrouped(steps: DataFrame) -> DataFrame:
    """(path, run, policy, nodes) of steps (path, pos, u, v, policy): neighbours of equal policy are one rule with the nodes along it; those without policy are none."""
    order = W.partitionBy("path").orderBy("pos")
    sign = F.col("policy").isNotNull() & (F.size("policy") > 0)
    own = F.when(sign, signature(F.col("policy")))
    marked = steps.withColumn("_s", own).withColumn("_new", (~F.col("_s").eqNullSafe(F.lag("_s").over(order)) | (F.row_number().over(order) == 1)).cast("int"))
    runs = marked.withColumn("run", F.sum("_new").over(order)).where("_s IS NOT NULL").groupBy("path", "run").agg(F.min_by("policy", "pos").alias("policy"), F.array_sort(F.collect_list(F.struct("pos", "u", "v"))).alias("s"))
    return runs.select("path", "run", "policy", F.concat(F.array(F.get("s", F.lit(0))["u"]), F.transform("s", lambda x: x["v"])).alias("nodes"))
