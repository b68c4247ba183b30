"""Polygons from GeoJSON, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geodesy import LocalFrame, to_tile

_ANY = "type string, coordinates string, geometry string, features array<string>"
MOST_VERTICES = 64


def first_ring(text: Column, nesting: int = 3) -> Column:
    """Exterior ring of the first polygon, as an array of positions; null where there is none or the text is no JSON.

    Features and collections may hold each other ``nesting`` deep.
    """
    j = F.from_json(text, _ANY)
    polygon = F.get(F.from_json(j["coordinates"], "array<array<array<double>>>"), F.lit(0))
    several = F.get(F.get(F.from_json(j["coordinates"], "array<array<array<array<double>>>>"), F.lit(0)), F.lit(0))
    found = F.when(j["type"] == "Polygon", polygon).when(j["type"] == "MultiPolygon", several)
    if nesting:
        rings = F.filter(F.transform(j["features"], lambda f: first_ring(f, nesting - 1)), lambda r: r.isNotNull())
        found = found.when(j["type"] == "Feature", first_ring(j["geometry"], nesting - 1)).when(j["type"] == "FeatureCollection", F.get(rings, F.lit(0)))
    return found


def corners(ring: Column, most: int = MOST_VERTICES) -> Column:
    """The ring without the last vertex that repeats the first, and no more than ``most``; null below three vertices.

    The most is the limit of the clipping feature that these polygons are for.
    """
    n = F.size(ring)
    first, last = F.get(ring, F.lit(0)), F.get(ring, n - 1)
    closed = (F.get(first, F.lit(0)) == F.get(last, F.lit(0))) & (F.get(first, F.lit(1)) == F.get(last, F.lit(1)))
    return F.when(n >= 3, F.slice(F.slice(ring, 1, F.when(closed, n - 1).otherwise(n)), 1, most))


def project(ring: Column, frame: LocalFrame) -> Column:
    """A ring's vertices at height 0 on the x and z axes of a local frame."""

    def one(v: Column) -> Column:
        p = frame.point_to_local(to_tile(F.get(v, F.lit(0)), F.get(v, F.lit(1)), F.lit(0.0)))
        return F.struct(p[0].alias("x"), p[2].alias("z"))

    return F.transform(ring, one)
