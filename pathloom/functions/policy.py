"""Rules on tags, as column expressions. ``tags`` is a map of text to text; a policy is four columns that may be null."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tag of each policy field, the other tags that rules read, and the values that mean something.
POLICY_TAGS = {"routing_state": "local:routing_state", "bikeability": "local:bikeability", "bicycle_direction": "local:bicycle_direction", "unavailable_until": "local:unavailable_until"}
ZONE_TAG, REFS_TAG, AVAILABILITY_TAG, CONTEXT_TAG = "local:boundary_zone", "local:boundary_refs", "local:availability", "local:context_only"
UNAVAILABLE, ZONES = "temporarily_unavailable", ("core", "buffer")
FIELDS = tuple(POLICY_TAGS)


def _is(tags: Column, key: str, value: str) -> Column:
    return F.coalesce(tags[key] == value, F.lit(False))


def iso_date(text: Column) -> Column:
    """The date of a strict YYYY-MM-DD text, else null."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, day)


def baseline(tags: Column) -> Column:
    return F.coalesce(F.map_contains_key(tags, "highway"), F.lit(False)) | _is(tags, "amenity", "parking")


def boundary_zone(tags: Column) -> Column:
    """``core`` or ``buffer``; anything else is core."""
    return F.when(_is(tags, ZONE_TAG, "buffer"), "buffer").otherwise("core")


def excluded_by_default(tags: Column) -> Column:
    return boundary_zone(tags) == "buffer"


def unavailable(tags: Column, on: Column) -> Column:
    """Up to and with the date; a text that is no date does not count."""
    return _is(tags, AVAILABILITY_TAG, UNAVAILABLE) | F.coalesce(on <= iso_date(tags[POLICY_TAGS["unavailable_until"]]), F.lit(False))


def explicitly_included(tags: Column) -> Column:
    return _is(tags, POLICY_TAGS["routing_state"], "include")


def rideable(tags: Column, on: Column) -> Column:
    """Exclude, then unavailable, then include, then the buffer, then context only, then the baseline."""
    return (
        F.when(_is(tags, POLICY_TAGS["routing_state"], "exclude") | unavailable(tags, on), False).when(explicitly_included(tags), True)
        .when(excluded_by_default(tags) | _is(tags, CONTEXT_TAG, "yes"), False).otherwise(baseline(tags))
    )


def editable(tags: Column) -> Column:
    return baseline(tags) | excluded_by_default(tags)


def policy_tags(tags: Column) -> Column:
    """Only the tags of policy fields."""
    return F.map_filter(tags, lambda k, v: k.isin(*POLICY_TAGS.values()))


def has_policy(tags: Column) -> Column:
    return F.size(policy_tags(tags)) > 0


def candidate(tags: Column, base: Column, selected: Column) -> Column:
    """Whether a segment may carry policy: in the base graph, selected by a rule, included by its tags, or in the core with a policy of its own."""
    return base | selected | explicitly_included(tags) | ((boundary_zone(tags) == "core") & has_policy(tags))


def traversable(tags: Column, on: Column, is_cycle: Column, forward: Column) -> Column:
    """The part of the traversal rule that does not depend on the walk: state, dates, buffer, and direction (``forward``: from first to second end)."""
    direction = F.coalesce(tags[POLICY_TAGS["bicycle_direction"]], F.lit("both"))
    wrong_way = ~is_cycle & (((direction == "forward") & ~forward) | ((direction == "backward") & forward))
    barred = _is(tags, POLICY_TAGS["routing_state"], "exclude") | unavailable(tags, on) | (~explicitly_included(tags) & excluded_by_default(tags))
    return ~(barred | wrong_way)


def reusable(visits: Column, length: Column, overlap: Column, short: float, budget: float) -> Column:
    """Whether a walk may take a contig for the ``visits`` + 1st time: the first always, the second as a short connector within the budget."""
    return (visits == 0) | ((visits == 1) & (length <= short) & (overlap + length <= budget))


def to_tags(fields: dict[str, Column]) -> Column:
    """Policy fields as tags, those that are null left out."""
    entries = F.array(*[F.struct(F.lit(POLICY_TAGS[f]).alias("key"), c.cast("string").alias("value")) for f, c in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def merged(base: dict[str, Column], over: dict[str, Column]) -> dict[str, Column]:
    """Fields of ``over`` where it has them, else of ``base``."""
    return {f: F.coalesce(over[f], base[f]) for f in base}


def explicit(effective: dict[str, Column], base: dict[str, Column]) -> dict[str, Column]:
    """What ``effective`` says beyond ``base``: null where both agree."""
    return {f: F.when(~effective[f].eqNullSafe(base[f]), effective[f]) for f in base}


def is_default(fields: dict[str, Column]) -> Column:
    """No field says anything; a direction of ``both`` says nothing."""
    out = F.lit(True)
    for f, c in fields.items():
        out = out & (c.isNull() | (c == "both") if f == "bicycle_direction" else c.isNull())
    return out


def display_class(fields: dict[str, Column], zone: Column, on: Column) -> Column:
    """What a map shows: unavailable, included, buffer, excluded, annotated or plain, in this order."""
    state = fields["routing_state"]
    return (
        F.when(F.coalesce(on <= iso_date(fields["unavailable_until"]), F.lit(False)), "unavailable").when(F.coalesce(state == "include", F.lit(False)), "included").when(zone == "buffer", "buffer_excluded")
        .when(F.coalesce(state == "exclude", F.lit(False)), "excluded").when(~is_default(fields), "annotated").otherwise("plain")
    )


def from_tag_patch(fields: dict[str, Column], removed: Column, put: Column) -> dict[str, Column]:
    """A policy after an old patch of tags: ``removed`` (array of tags) first, then ``put`` (map of tags); null does nothing.

    A direction that is removed is ``both``, a state ``default``. The old availability tag is a date that never comes, and goes with the date.
    ``tag_patch_problems`` says which patches must not be read.
    """
    has = lambda tag: F.coalesce(F.array_contains(removed, tag), F.lit(False))
    empty = {"routing_state": F.lit("default"), "bicycle_direction": F.lit("both")}
    out = {}
    for f, c in fields.items():
        tag = POLICY_TAGS[f]
        old = F.when(has(tag) | (has(AVAILABILITY_TAG) if f == "unavailable_until" else F.lit(False)), empty.get(f, F.lit(None).cast("string"))).otherwise(c.cast("string"))
        new = put[tag]
        if f == "unavailable_until":
            new = F.coalesce(new, F.when(_is(put, AVAILABILITY_TAG, UNAVAILABLE), F.lit("9999-12-31")))
        out[f] = F.coalesce(new, old)
    return out


def tag_patch_problems(put: Column) -> dict[str, Column]:
    """What is wrong with the tags that an old patch puts."""
    state, grade, direction, until = (put[POLICY_TAGS[f]] for f in FIELDS)
    return {
        "routing_state is not known": ~state.isin("default", "include", "exclude"), "bikeability must be an integer from 1 to 5": grade.isNotNull() & ~grade.isin(*"12345"),
        "bicycle_direction is not known": ~direction.isin("both", "forward", "backward"), "unavailable_until must be a date": until.isNotNull() & iso_date(until).isNull(),
        "availability must be temporarily_unavailable": put[AVAILABILITY_TAG] != UNAVAILABLE}


def touches(tags: Column, refs: Column) -> Column:
    """A contig lies in an area if its boundary refs, a comma-separated tag, have one of the area's; an area without refs has all."""
    own = F.filter(F.split(F.coalesce(tags[REFS_TAG], F.lit("")), ","), lambda x: x != "")
    return (F.coalesce(F.size(refs), F.lit(0)) == 0) | F.coalesce(F.arrays_overlap(own, refs), F.lit(False))
