"""Cameras and movers as Column expressions: bases, paths, orbits, walks, node transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import LocalFrame, Vector, dot, length

# Metres of a degree of latitude, and limits of an orbit.
METRES_PER_DEGREE = 111320.0
ORBIT_DISTANCE, ORBIT_PITCH = (5.0, 1e5), (-10.0, 85.0)


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(v: Vector) -> Vector:
    """The direction of a vector; zero stays zero."""
    n = length(v)
    return tuple(F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in v)


def spherical_basis(position: Vector) -> tuple[Vector, Vector, Vector]:
    """(right, up, forward) of one who stands on a sphere about the origin; zero vectors on its axis and in its centre."""
    up = unit(position)
    right = unit(cross(up, (F.lit(0.0), F.lit(1.0), F.lit(0.0))))
    return right, up, cross(right, up)


def pose_to_tile(frame: LocalFrame, position: Vector, *directions: Vector) -> list[Vector]:
    """A camera's position in tile axes, and its directions, which are turned but not moved."""
    zero = frame.point_to_tile((F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return [frame.point_to_tile(position)] + [tuple(c - o for c, o in zip(frame.point_to_tile(d), zero)) for d in directions]


def walk(lon: Column, lat: Column, heading: Column, metres: Column, origin: tuple[float, float], radius: float) -> tuple[Column, Column, Column]:
    """(lon, lat, heading) after a step over flat ground; beyond the radius the heading turns to the origin."""
    east = METRES_PER_DEGREE * math.cos(math.radians(origin[1]))
    x, y = lon + F.sin(heading) * metres / east, lat + F.cos(heading) * metres / METRES_PER_DEGREE
    off_e, off_n = (x - origin[0]) * east, (y - origin[1]) * METRES_PER_DEGREE
    return x, y, F.when(F.hypot(off_e, off_n) > radius, F.atan2(-off_e, -off_n)).otherwise(heading)


def orbit(heading: Column, pitch: Column, distance: Column) -> Vector:
    """East, north and up from an orbit's target to its camera, for degrees; pitch and distance are held in their limits."""
    p = F.radians(F.greatest(F.lit(ORBIT_PITCH[0]), F.least(F.lit(ORBIT_PITCH[1]), pitch)))
    d = F.greatest(F.lit(ORBIT_DISTANCE[0]), F.least(F.lit(ORBIT_DISTANCE[1]), distance))
    h = F.radians(heading)
    return F.sin(h) * F.cos(p) * d, -F.cos(h) * F.cos(p) * d, F.sin(p) * d


def pinched(distance: Column, before: Column, after: Column) -> Column:
    """An orbit's distance after two fingers moved apart from ``before`` to ``after``; unchanged where either is zero."""
    moved = F.greatest(F.lit(ORBIT_DISTANCE[0]), F.least(F.lit(ORBIT_DISTANCE[1]), distance * before / after))
    return F.when((before > 0) & (after > 0), moved).otherwise(distance)


def twisted(heading: Column, before: Column, after: Column) -> Column:
    """An orbit's heading after two fingers turned, in radians; half a turn is the most that counts."""
    d = after - before
    return heading - F.degrees(F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d))


def along(points: list[tuple[float, float, float]], progress: Column) -> Vector:
    """The place on a path of two points or more at a progress from 0 to 1, each stretch taking as long."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress)) * (len(points) - 1)
    stretch = F.least(F.lit(len(points) - 2), F.floor(at)).cast("int")
    share = at - stretch

    def axis(k: int) -> Column:
        values = F.array(*[F.lit(float(p[k])) for p in points])
        low = F.get(values, stretch)
        return low + (F.get(values, stretch + 1) - low) * share

    return axis(0), axis(1), axis(2)


def place(point: Vector, translation: Vector, rotation: tuple[Column, Column, Column, Column], scale: Vector) -> Vector:
    """A point of a node: scaled, turned by a unit quaternion (x, y, z, w), then moved."""
    v = tuple(p * s for p, s in zip(point, scale))
    axis, w = rotation[:3], rotation[3]
    t = tuple(2 * c for c in cross(axis, v))
    turned = tuple(a + w * b + c for a, b, c in zip(v, t, cross(axis, t)))
    return tuple(a + b for a, b in zip(turned, translation))


def preparation_score(to_tile: Vector, velocity: Vector, forward: Vector, selected: Column, immune: Column) -> Column:
    """How soon a loaded tile is prepared: selected and immune ones, those ahead and those travelled to, first; those behind last."""
    base = F.when(F.coalesce(selected, F.lit(False)), 4.0).otherwise(0.0) + F.when(F.coalesce(immune, F.lit(False)), 6.0).otherwise(0.0)
    far, speed = F.greatest(length(to_tile), F.lit(1e-6)), F.greatest(length(velocity), F.lit(1e-6))
    ahead, travel = dot(to_tile, forward) / far, dot(to_tile, velocity) / (far * speed)
    return base + F.coalesce(2 * ahead + 2.5 * travel - F.when(ahead < -0.2, 3.0).otherwise(0.0), F.lit(0.0))


def quaternion(m: tuple[Vector, Vector, Vector]) -> tuple[Column, Column, Column, Column]:
    """(x, y, z, w) of a rotation given by the rows of its matrix.

    w is found first and is positive where the trace is, else the largest of the others is.
    """
    (a, b, c), (d, e, f), (g, h, i) = m
    squares = {"w": a + e + i, "x": a - e - i, "y": e - a - i, "z": i - a - e}
    parts = {
        "w": {"x": h - f, "y": c - g, "z": d - b}, "x": {"w": h - f, "y": b + d, "z": c + g}, "y": {"w": c - g, "x": b + d, "z": f + h}, "z": {"w": d - b, "x": c + g, "y": f + h},
    }
    turn = F.greatest(squares["x"], squares["y"], squares["z"])
    first = {"w": squares["w"] > 0} | {k: squares[k] == turn for k in "xyz"}

    def component(name: str) -> Column:
        found = None
        for k, square in squares.items():
            root = F.sqrt(F.greatest(square + 1, F.lit(0.0)))
            value = root / 2 if k == name else parts[k][name] / (2 * root)
            found = F.when(first[k], value) if found is None else found.when(first[k], value)
        return found

    return component("x"), component("y"), component("z"), component("w")


def velocity(position: Vector, before: Vector, at_ms: Column, before_ms: Column) -> Vector:
    """Metres a second since the position before, over a millisecond at least; null where there is none before."""
    seconds = F.greatest(F.lit(1e-3), (at_ms - before_ms) / 1000)
    return tuple((p - q) / seconds for p, q in zip(position, before))
