"""Texts that documents and displays are made of, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def xml_escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, as eight hex digits."""
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)")), lambda x: F.conv(x, 16, 10).cast("long"))
    h = F.aggregate(octets, F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def rule_id(way_ids: Column, node_ids: Column, prefix: str = "route-policy-path-") -> Column:
    """A rule's id from its selector: the hash of compact JSON, keys and way ids in order."""
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return F.concat(F.lit(prefix), fnv1a(F.concat(F.lit('{"node_ids":['), ids(node_ids), F.lit('],"way_ids":['), ids(F.array_sort(F.array_distinct(way_ids))), F.lit("]}"))))


def pixel(x: Column, y: Column, bounds: tuple[float, float, float, float], width: int, height: int) -> tuple[Column, Column]:
    """Map metres to pixels of a picture that shows ``bounds`` (x0, y0, x1, y1); y runs downward."""
    x0, y0, x1, y1 = bounds
    return (x - x0) / (x1 - x0) * width, (F.lit(y1) - y) / (y1 - y0) * height


def local_date(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def distance_text(metres: Column) -> Column:
    """Kilometres with two decimals."""
    return F.format_string("%.2f km", F.floor(metres / 10 + 0.5) / 100)


def climb_text(metres: Column) -> Column:
    """Whole metres."""
    return F.format_string("%d m", F.floor(metres + 0.5))


def asset_suffix(at: Column) -> Column:
    """A time as it stands in asset ids: lower case, no separators, seconds only."""
    return F.lower(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def polyline(points: Column) -> Column:
    """Points (lon, lat) as the text of the public polyline format: steps of latitude and longitude in 1e-5 degrees, five bits a character."""
    at = F.transform(points, lambda p: F.array(F.rint(p["lat"] * 1e5).cast("long"), F.rint(p["lon"] * 1e5).cast("long")))
    start = F.array(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")))
    # The points are worked out once: each is held against the one before it.
    steps = F.flatten(F.get(F.transform(F.array(at), lambda a: F.zip_with(a, F.slice(F.concat(start, a), F.lit(1), F.size(a)), lambda p, q: F.zip_with(p, q, lambda x, y: x - y))), F.lit(0)))
    signed = F.transform(steps, lambda v: F.when(v < 0, -2 * v - 1).otherwise(2 * v))

    def written(v: Column, k: int = 0) -> Column:
        bits, more = F.shiftright(v, 5 * k).bitwiseAND(F.lit(31)), v >= F.lit(1 << 5 * (k + 1))
        last = F.char(bits + 63)
        return F.when(more, F.char(bits + 95) if k == 7 else F.concat(F.char(bits + 95), written(v, k + 1))).otherwise(last)

    return F.array_join(F.transform(signed, lambda v: written(v)), "")
