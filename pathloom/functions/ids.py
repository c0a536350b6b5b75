"""Stable ids and canonical forms."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_digest(text: Column) -> Column:
    """The first 12 hex digits of the SHA-1 of a canonical text."""
    return F.substring(F.sha1(text), 1, 12)


def id_list(ids: Column) -> Column:
    """An array of ids as compact JSON."""
    return F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit("]"))


def canonical(sequence: Column) -> Column:
    """The lesser of a sequence of numbers and its reverse, compared number by number."""
    return F.least(sequence, F.reverse(sequence))


def forward(sequence: Column) -> Column:
    return sequence <= F.reverse(sequence)


def family_id(sequence: Column, prefix: str = "route-family-") -> Column:
    """One id for a sequence and its reverse."""
    return F.concat(F.lit(prefix), short_digest(F.array_join(F.transform(canonical(sequence), lambda x: x.cast("string")), ",")))
