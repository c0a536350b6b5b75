"""Contracts of documents as data: rules on the places of a document, checked for all documents in a few joins."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import iso_date

_KINDS = {
    "object": "must be an object", "filled": "must be an object with a field", "array": "must be an array", "string": "must be a non-empty string", "text": "must be a string", "integer": "must be an integer",
    "number": "must be a number", "boolean": "must be a boolean", "date": "must be a valid YYYY-MM-DD date", "one of": "must be one of", "positive integer": "must be a positive integer",
    "positive number": "must be a positive number", "grade": "must be an integer from 1 to 5",
}


@dataclass(frozen=True)
class Rule:
    """At ``place`` (``$.a.b[*].c``) stands a value of ``kind``. ``least`` and ``most`` bound the parts of an array; ``optional`` allows null or nothing."""

    place: str
    kind: str
    least: int = 0
    most: int | None = None
    values: tuple[str, ...] = ()
    optional: bool = False


def each(base: str, kind: str, *names: str, **more) -> list[Rule]:
    return [Rule(f"{base}.{n}", kind, **more) for n in names]


def many(place: str, kind: str, least: int = 0, most: int | None = None, optional: bool = False) -> list[Rule]:
    """An array of values of one kind."""
    return [Rule(place, "array", least, most, optional=optional), Rule(f"{place}[*]", kind)]


def _endpoint(name: str) -> list[Rule]:
    at = f"$.{name}"
    return [Rule(at, "object"), *each(at, "string", "junction_id", "name"), Rule(f"{at}.graph_node_id", "integer"), *many(f"{at}.incident_contig_ids", "integer"), Rule(f"{at}.location", "object"),
            *each(f"{at}.location", "number", "lat", "lon"), Rule(f"{at}.notes", "text", optional=True), Rule(f"{at}.tags", "array", optional=True)]


def _route(at: str) -> list[Rule]:
    """A planned route as it is told to a page."""
    heights = each(at, "number", "elevation_gain_m", "elevation_loss_m", "elevation_min_m", "elevation_max_m", optional=True)
    return [Rule(at, "object"), *each(at, "string", "id", "algorithm"), *each(at, "integer", "seed", "step_count"), Rule(f"{at}.complete", "boolean"), *each(at, "number", "score", "total_length_m", "unique_length_m", "overlap_length_m"),
            *many(f"{at}.repeated_contig_ids", "integer"), *many(f"{at}.bounds", "number", 4, 4), *many(f"{at}.coordinates", "array", 2), Rule(f"{at}.coordinates[*]", "array", 2, 2), Rule(f"{at}.coordinates[*][*]", "number"),
            *many(f"{at}.route_node_ids", "integer"), *many(f"{at}.contig_id_sequence", "integer"), *many(f"{at}.elevations_m", "number", optional=True), *heights]


_META = [Rule("$", "object"), Rule("$.meta", "object"), *each("$.meta", "string", "asset_id", "asset_kind")]
_AREA, _ITEM, _RULE, _STEP = "$.areas[*]", "$.figures[*].items[*]", "$.rules[*]", "$.routes[*].steps[*]"
#: Fixed names of the fields of a policy and of the sections of a build configuration.
POLICY_FIELDS = ("routing_state", "bikeability", "bicycle_direction", "unavailable_until")
SECTIONS = ("debug_catalog", "planner", "browser_runtime")
CONTRACTS: dict[str, list[Rule]] = {
    "policy": [*_META, Rule("$.rules", "array"), Rule(_RULE, "object"), Rule(f"{_RULE}.id", "string"), Rule(f"{_RULE}.selector", "object"), *many(f"{_RULE}.selector.way_ids", "integer", 1), *many(f"{_RULE}.selector.node_ids", "integer", 2),
               Rule(f"{_RULE}.policy", "filled", values=POLICY_FIELDS), Rule(f"{_RULE}.policy.routing_state", "one of", values=("include", "exclude"), optional=True), Rule(f"{_RULE}.policy.bikeability", "grade", optional=True),
               Rule(f"{_RULE}.policy.bicycle_direction", "one of", values=("forward", "backward"), optional=True), Rule(f"{_RULE}.policy.unavailable_until", "date", optional=True)],
    "figures": [*_META, Rule("$.figures", "array"), Rule("$.figures[*]", "object"), *each("$.figures[*]", "string", "id", "kind", "output_path"), Rule("$.figures[*].header", "object"), *each("$.figures[*].header", "string", "title", "subtitle"),
                Rule("$.figures[*].items", "array"), Rule(_ITEM, "object"), Rule(f"{_ITEM}.junction_id", "string"), *many(f"{_ITEM}.color", "integer", 4, 4), *each(_ITEM, "number", "label_dx", "label_dy"), Rule(f"{_ITEM}.subtitle_template", "text", optional=True)],
    "routes": [*_META, *each("$.meta", "string", "algorithm", "graph_asset_id", "graph_path", "junction_catalog_asset_id", "start_junction_id", "end_junction_id"), Rule("$.meta.junction_bindings_asset_id", "string", optional=True),
               Rule("$.meta.seed", "integer"), Rule("$.config", "filled"), *_endpoint("start"), *_endpoint("end"), Rule("$.routes", "array"), Rule("$.routes[*]", "object"), Rule("$.routes[*].complete", "boolean"), Rule("$.routes[*].score", "number"),
               *many("$.routes[*].route_node_ids", "integer"), Rule("$.routes[*].steps", "array"), Rule(_STEP, "object"), *each(_STEP, "integer", "contig_id", "from_node_id", "to_node_id"), Rule(f"{_STEP}.reused", "boolean"), Rule(f"{_STEP}.length_m", "number")],
    "build": [Rule("$", "object", values=SECTIONS), *each("$", "object", *SECTIONS, optional=True), *[Rule("$.debug_catalog.algorithms", "array", 1, optional=True)],
              *each("$.browser_runtime", "positive integer", "browser_selection_pool", "browser_selection_window", "browser_mcts_iterations", "browser_mcts_rollout_top_k", "browser_mcts_rollout_samples", "browser_mcts_progress_interval_iterations", optional=True),
              Rule("$.browser_runtime.browser_mcts_time_budget_ms", "positive number", optional=True)],
    "app": [Rule("$", "object"), Rule("$.meta", "object", optional=True), Rule("$.planner", "object"), *each("$.planner", "string", "network_path", "network_version", "background_network_path", "background_network_version"), Rule("$.planner.config", "object"),
            Rule("$.areas", "array", 1), Rule(_AREA, "object"), *each(_AREA, "string", "id", "name", "network_path", "network_version", "background_network_path", "background_network_version"), *many(f"{_AREA}.boundary_refs", "string"),
            *many(f"{_AREA}.bounds", "number", 4, 4), Rule(f"{_AREA}.junctions", "array", 1), Rule(f"{_AREA}.junctions[*]", "object"), *each(f"{_AREA}.junctions[*]", "string", "id", "name"), Rule(f"{_AREA}.junctions[*].location", "object"),
            *each(f"{_AREA}.junctions[*].location", "number", "lat", "lon"), Rule(f"{_AREA}.junctions[*].graph_node_id", "integer"), Rule(f"{_AREA}.junctions[*].tags", "array", optional=True),
            Rule(f"{_AREA}.scenarios", "array", 1), Rule(f"{_AREA}.scenarios[*]", "object"), *each(f"{_AREA}.scenarios[*]", "string", "id", "start_junction_id", "end_junction_id"), Rule(f"{_AREA}.scenarios[*].is_loop", "boolean")],
    "editor": [Rule("$", "object"), Rule("$.meta", "object"), Rule("$.editor", "object"), *each("$.meta", "string", "editor_graph_asset_id", "route_policy_path", "route_policy_digest", "generated_at"), *each("$.editor", "string", "network_path", "network_version")],
    "request": [Rule("$", "object"), Rule("$.type", "string"), Rule("$.requestId", "integer"), Rule("$.payload", "object")],
    "init": [Rule("$", "object"), *each("$", "object", "network", "config")],
    "plan": [Rule("$", "object"), Rule("$.routeId", "string"), *each("$", "integer", "startNodeId", "endNodeId", "seed"), *many("$.recentRouteContigSequences", "array", optional=True), Rule("$.recentRouteContigSequences[*][*]", "integer")],
    "history": [Rule("$", "array"), Rule("$[*]", "array"), Rule("$[*][*]", "integer")],
    "route": _route("$"),
    "booted": [Rule("$", "object"), Rule("$.requestId", "integer"), Rule("$.payload", "object")],
    "error": [Rule("$", "object"), Rule("$.requestId", "integer"), Rule("$.payload", "object"), Rule("$.payload.message", "string")],
    "ready": [Rule("$", "object"), Rule("$.requestId", "integer"), Rule("$.payload", "object"), *each("$.payload", "integer", "contigCount", "nodeCount")],
    "planned": [Rule("$", "object"), Rule("$.requestId", "integer"), *_route("$.payload")],
}


def problems(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc, path, problem) of unfolded documents (``variants.unfolded``): every value that a rule asks for and that is missing or of another kind.

    What is inside of a missing container is not asked for. A rule with ``values`` on an object names all fields that it may have.
    """
    spark = rows.sparkSession
    split = [(r.place, *(r.place.rsplit(".", 1) if not r.place.endswith("]") and "." in r.place else (None, None)), r.kind, r.least, r.most, list(r.values), r.optional) for r in rules]
    # What an object must have is a set of bits for each 60 of its rules.
    bits, seen = [], {}
    for r in split:
        k = seen[r[1]] = seen.get(r[1], -1) + 1
        bits.append((*r, k // 60, 1 << k % 60))
    columns = ["kind", "least", "most", "values", "optional"]
    table = spark.createDataFrame(bits, "place string, asked_in string, name string, kind string, least int, most int, values array<string>, optional boolean, part int, bit long")
    # The rules are a fixed list, so they can be sent to every task. Values that are there meet them by place; what is missing is told by the bits.
    must = table.where("name IS NOT NULL AND NOT optional")
    every = rows.select("doc", "path", "place", "type", "text", "size").join(F.broadcast(table.select("place", *columns)), "place").select("doc", "path", *columns, "type", "text", "size")
    no, nothing = F.lit(0).cast("long"), F.lit(None).cast("string")
    wanted = rows.where("type = 'OBJECT'").join(F.broadcast(must.groupBy("asked_in", "part").agg(F.bit_or("bit").alias("want"))), rows.place == F.col("asked_in")).select("doc", "path", "part", "asked_in", "want", no.alias("have"))
    there = rows.where("key IS NOT NULL").join(F.broadcast(must.select("place", "part", "bit")), "place").select("doc", F.col("above").alias("path"), "part", F.col("above_place").alias("asked_in"), no.alias("want"), F.col("bit").alias("have"))
    lacking = wanted.unionByName(there).groupBy("doc", "path", "part", "asked_in").agg(F.bit_or("want").alias("want"), F.bit_or("have").alias("have")).where("want & ~have <> 0")
    missing = lacking.join(F.broadcast(must), ["asked_in", "part"]).where("want & ~have & bit <> 0").withColumn("path", F.concat("path", F.lit("."), "name"))
    every = every.unionByName(missing.select("doc", "path", *columns, nothing.alias("type"), nothing.alias("text"), F.lit(None).cast("int").alias("size")))
    kind, of, text, size = F.col("kind"), F.coalesce("type", F.lit("NONE")), F.col("text"), F.col("size")
    number = of.isin("INTEGER", "NUMBER")
    good = (
        F.when(kind == "object", of == "OBJECT").when(kind == "filled", (of == "OBJECT") & (size > 0)).when(kind == "array", of == "ARRAY").when(kind == "string", (of == "STRING") & (text != "")).when(kind == "text", of == "STRING")
        .when(kind == "integer", of == "INTEGER").when(kind == "number", number).when(kind == "boolean", of == "BOOLEAN").when(kind == "date", (of == "STRING") & iso_date(text).isNotNull()).when(kind == "one of", F.array_contains("values", text) & (of == "STRING"))
        .when(kind == "positive integer", (of == "INTEGER") & (text.try_cast("double") >= 1)).when(kind == "positive number", number & (text.try_cast("double") > 0)).when(kind == "grade", (of == "INTEGER") & text.isin(*"12345"))
    )
    said = F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), kind)
    many_ = (of == "ARRAY") & (size < F.col("least"))
    problem = (
        F.when(F.col("optional") & of.isin("NONE", "VOID"), None).when(~F.coalesce(good, F.lit(False)), F.when(kind == "one of", F.concat(said, F.lit(" "), F.array_join("values", ", "))).otherwise(said))
        .when(many_, F.concat(F.lit("must have at least "), F.col("least").cast("string"), F.lit(" items"))).when((of == "ARRAY") & (size > F.col("most")), F.concat(F.lit("must have at most "), F.col("most").cast("string"), F.lit(" items")))
    )
    found = every.withColumn("problem", problem).where("problem IS NOT NULL").select("doc", "path", "problem")
    closed = F.broadcast(table.where("kind IN ('object', 'filled') AND size(values) > 0").select(F.col("place").alias("above_place"), "values"))
    extra = rows.where("key IS NOT NULL").join(closed, "above_place").where(~F.array_contains("values", F.col("key"))).select("doc", "path", F.lit("is not a known field").alias("problem"))
    return found.unionByName(extra).distinct()


def unknown_ends(rows: DataFrame) -> DataFrame:
    """(doc, path, problem) of scenarios of app manifests whose ends are no junctions of their area."""
    area = F.regexp_extract("path", r"^\$\.areas\[\d+\]", 0)
    known = rows.where("place = '$.areas[*].junctions[*].id'").select("doc", area.alias("area"), "text").distinct()
    ends = rows.where("place IN ('$.areas[*].scenarios[*].start_junction_id', '$.areas[*].scenarios[*].end_junction_id')").select("doc", "path", area.alias("area"), "text")
    return ends.join(known, ["doc", "area", "text"], "left_anti").select("doc", "path", F.lit("is no junction of its area").alias("problem"))
