"""Documents that others read: GeoJSON, GPX, JSON and Markdown, as text columns or text files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape

_POINT = '      <trkpt lat="%s" lon="%s">'


def feature(contig: Column, coordinates: Column, properties: dict[str, Column], elevations: Column | None = None) -> Column:
    """A LineString feature as JSON; coordinates with six decimals. ``elevations``, where not null, go with the properties."""
    fields = [contig.alias("contig_id"), *[c.alias(k) for k, c in properties.items()]]
    if elevations is not None:
        fields.append(F.transform(elevations, lambda v: F.round(v, 1)).alias("elevations_m"))
    line = F.struct(F.lit("LineString").alias("type"), F.transform(coordinates, lambda p: F.array(F.round(p[0], 6), F.round(p[1], 6))).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*fields).alias("properties"), line.alias("geometry")))


def write_collection(features: DataFrame, path: str, order: str) -> None:
    """Features (``feature``: JSON text) as lines in ``order``, one feature in a line, in as many files as there are partitions."""
    features.repartitionByRange(F.col(order)).sortWithinPartitions(order).select("feature").write.mode("overwrite").text(path)


def write_by_area(features: DataFrame, areas: DataFrame, path: str) -> None:
    """Features (feature, refs: array) below ``path``/area=..., each in every area (area, refs) that it touches; areas without refs take all.

    Areas are a curated list. Raises where an area would be empty.
    """
    a = areas.select("area", F.col("refs").alias("_refs"))
    touched = features.join(F.broadcast(a), (F.size("_refs") == 0) | F.arrays_overlap("refs", "_refs"))
    empty = a.join(touched.select("area").distinct(), "area", "left_anti").first()
    if empty is not None:
        raise ValueError(f"area {empty.area} has no features")
    touched.select("area", "feature").write.mode("overwrite").partitionBy("area").text(path)


def gpx(name: Column, title: Column, points: Column, elevations: Column, creator: str = "pathloom") -> Column:
    """A GPX track from texts, points (array of lon, lat) and elevations, which count only if there is one for each point."""
    whole = F.coalesce(F.size(elevations) == F.size(points), F.lit(False))
    text = lambda v: F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    begin = lambda p: F.format_string(_POINT, text(p[1]), text(p[0]))
    plain = F.transform(points, lambda p: F.concat(begin(p), F.lit("</trkpt>")))
    high = F.zip_with(points, elevations, lambda p, e: F.concat(begin(p), F.format_string("\n        <ele>%.1f</ele>\n      </trkpt>", e)))
    head = F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata>\n    <name>')
    return F.concat(head, xml_escape(name), F.lit("</name>\n  </metadata>\n  <trk>\n    <name>"), xml_escape(title), F.lit("</name>\n    <trkseg>\n"), F.array_join(F.when(whole, high).otherwise(plain), "\n"), F.lit("\n    </trkseg>\n  </trk>\n</gpx>\n"))


def write_json(rows: DataFrame, path: str, sort_keys: bool = False) -> None:
    """Rows as JSON lines, with fields in order of name if asked."""
    (rows.select(*sorted(rows.columns)) if sort_keys else rows).write.mode("overwrite").json(path)


def markdown(summary: DataFrame, columns: list[str]) -> str:
    """A table of a summary, which has a row for each scenario and planner."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    cell = lambda v: f"{v:.2f}" if isinstance(v, float) else str(v)
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in summary.select(*columns).collect())]) + "\n"


def differences(made: DataFrame, stored: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one table that the other lacks (side: made or stored), ``volatile`` columns left out: none if a rebuild gives the same."""
    a, b = made.drop(*volatile), stored.drop(*volatile).select(*made.drop(*volatile).columns)
    return a.exceptAll(b).withColumn("side", F.lit("made")).unionByName(b.exceptAll(a).withColumn("side", F.lit("stored")))
