"""Predicates and scores of tiles for a camera, as Column expressions.

Missing input has the default of each predicate: no box is in view, is refined, has a screen-space error of 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import Vector, dot, length

MAX_SSE = 16.0
FALLBACK_FACTOR = 8.0
PRELOAD_FACTOR = 3.0
#: Class of a request: what it adds to a priority, and its rank.
CLASS_BONUS = {"frontier": 8.0, "visible": 4.0, "predicted": 2.0, "coverage": 0.0, "speculative": -2.0}
CLASS_RANK = {"speculative": 0, "coverage": 1, "predicted": 2, "visible": 3, "frontier": 4}


def in_view(center: Vector, half_axes: Column, planes: list[tuple[float, float, float, float]]) -> Column:
    """Unless a plane has the whole bounding sphere behind it.  half_axes: sum of the squares of the nine components."""
    keep = F.lit(True)
    for nx, ny, nz, d in planes:
        keep = keep & (center[0] * nx + center[1] * ny + center[2] * nz + d >= -F.sqrt(half_axes))
    return F.coalesce(keep, F.lit(True))


def sse(ge: Column, distance: Column, fov: float | Column, height: float | Column) -> Column:
    """Screen-space error in pixels; 0 where it can't be measured."""
    return F.coalesce(ge * height / (F.greatest(distance, F.lit(1e-7)) * 2 * F.tan(F.lit(fov) / 2)), F.lit(0.0))


def refines(ge: Column, distance: Column, fov: float, height: float, factor: Column | float = 1.0, bias: Column | float = 1.0) -> Column:
    return F.coalesce(sse(ge, distance, fov, height) > F.lit(MAX_SSE) * factor * bias, F.lit(True))


def usable_ancestor(ge: Column, distance: Column, fov: float, height: float) -> Column:
    error = sse(ge, distance, fov, height)
    return (error == 0) | (error <= MAX_SSE * FALLBACK_FACTOR)


def preloads(error: Column, factor: Column | float = 1.0) -> Column:
    return (error == 0) | (error <= F.lit(MAX_SSE) * factor * PRELOAD_FACTOR)


def in_cone(tile: Vector, camera: Vector, cosine: float) -> Column:
    """Whether a tile is on the camera's side of the globe; tiles near the centre, such as wrappers, always are."""
    t2, c2, d = dot(tile, tile), dot(camera, camera), dot(tile, camera)
    return (t2 <= 0.01 * c2) | ((d >= 0) & (d * d >= cosine * cosine * c2 * t2))


def predicted(to_tile: Vector, velocity: Vector, forward: Vector, ahead: float = 1.5) -> Column:
    """Whether the camera moves towards a tile: fast enough, aligned, closer after the look-ahead, and not looking away."""
    speed, distance = length(velocity), length(to_tile)
    later = length(tuple(t - v * ahead for t, v in zip(to_tile, velocity)))
    alignment = dot(to_tile, velocity) / (F.greatest(distance, F.lit(1e-6)) * F.greatest(speed, F.lit(1e-6)))
    facing = dot(to_tile, forward) / F.greatest(distance, F.lit(1e-6))
    return (speed >= 2) & (alignment >= 0.25) & (later < distance) & (facing >= -0.5)


def behind(to_tile: Vector, velocity: Vector, forward: Vector) -> Column:
    speed, distance = length(velocity), F.greatest(length(to_tile), F.lit(1e-6))
    motion = dot(to_tile, velocity) / (distance * F.greatest(speed, F.lit(1e-6)))
    return (dot(to_tile, forward) / distance < -0.2) & ((speed < 2) | (motion < -0.2))


def view_class(seen: Column, expected: Column, back: Column) -> tuple[Column, Column]:
    """(factor of the refinement threshold, request class)."""
    factor = F.when(seen, 1.0).when(expected, 1.75).when(back, 8.0).otherwise(4.0)
    return factor, F.when(seen, "visible").when(expected, "predicted").otherwise("coverage")


def priority(error: Column, to_tile: Vector, velocity: Vector, forward: Vector) -> Column:
    """Base priority: error, nearness to the centre of the view and to the camera, alignment with the motion."""
    d = length(to_tile)
    far = F.greatest(d, F.lit(1e-6))
    cosine = dot(to_tile, forward) / far
    v2 = dot(velocity, velocity)
    motion = F.when(v2 > 1, dot(to_tile, velocity) / (far * F.sqrt(v2))).otherwise(0.0)
    by_error = F.when(error > 0, 1 / (1 + F.log(F.greatest(error / MAX_SSE, F.lit(1.0))))).otherwise(1 / (1 + d * 1e-5))
    return by_error + 0.7 * F.greatest(F.lit(0.0), cosine) + 0.3 / (1 + d * 1e-4) + 0.5 * motion - F.when((cosine < 0) & (motion < 0), 0.75).otherwise(0.0)


def class_bonus(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CLASS_BONUS.items() for x in kv])[name]


def class_rank(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CLASS_RANK.items() for x in kv])[name]


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Crossing number with half-open edges, each from the vertex before."""
    crossed = F.lit(0)
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]):
        if yi != yj:
            hit = ((F.lit(yi) > lat) != (F.lit(yj) > lat)) & (lon < (xj - xi) * (lat - yi) / (yj - yi) + xi)
            crossed = crossed + F.when(hit, 1).otherwise(0)
    return crossed % 2 == 1


def ray_triangle(origin: Vector, direction: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Distance along a ray to a triangle, from either side; null where it misses."""
    e1, e2 = (tuple(x - y for x, y in zip(p, a)) for p in (b, c))
    p = _cross(direction, e2)
    det = dot(e1, p)
    s = tuple(x - y for x, y in zip(origin, a))
    q = _cross(s, e1)
    u, v, t = dot(s, p) / det, dot(direction, q) / det, dot(e2, q) / det
    return F.when((F.abs(det) >= 1e-8) & (u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def _cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dither_keep(x: Column, y: Column, progress: Column, fading_in: Column) -> Column:
    """Ordered dither: a fragment's threshold against the progress of a fade."""
    inner = x * 0.06711056 + y * 0.00583715
    outer = 52.9829189 * (inner - F.floor(inner))
    threshold = outer - F.floor(outer)
    return F.when(fading_in, threshold < progress).otherwise(threshold >= progress)
