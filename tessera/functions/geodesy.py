"""WGS84, Earth-centred and local frames as Column expressions.  Lon and lat are in degrees.

Earth-centred positions are ECEF, Z up; tile positions are on remapped axes: x = X, y = Z, z = -Y.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of WGS84.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = 2 * FLATTENING - FLATTENING * FLATTENING

Vector = tuple[Column, Column, Column]


def to_ecef(lon: Column, lat: Column, alt: Column) -> Vector:
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(phi) * F.sin(phi))
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * (1 - F.lit(E2)) + alt) * F.sin(phi)


def remap(v: Vector) -> Vector:
    return v[0], v[2], -v[1]


def to_tile(lon: Column, lat: Column, alt: Column) -> Vector:
    return remap(to_ecef(lon, lat, alt))


def to_geodetic(x: Column, y: Column, z: Column, steps: int = 6) -> Vector:
    """(lon, lat, alt) of a tile position, by a fixed number of fixed-point steps; six are enough below 1000 km."""
    p = F.sqrt(x * x + z * z)

    def step(was: Column, _: Column) -> Column:
        n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(was["lat"]) * F.sin(was["lat"]))
        alt = p / F.cos(was["lat"]) - n
        return F.struct(F.atan2(y, p * (1 - F.lit(E2) * n / (n + alt))).alias("lat"), alt.alias("alt"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.atan2(y, p * (1 - F.lit(E2))).alias("lat"), F.lit(0.0).alias("alt")), step)
    lat, alt = found["lat"], found["alt"]
    return F.degrees(F.atan2(-z, x)), F.degrees(lat), alt


def length(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


@dataclass(frozen=True)
class LocalFrame:
    """A frame at an origin: x east, y up, z south, turned by yaw, pitch and roll (degrees about y, x, z)."""

    origin: tuple[float, float, float]
    to_tile: tuple[tuple[float, float, float], ...]
    #: Rows of the frame as it is before it is turned: east, up and south on the tile axes.
    basis: tuple[tuple[float, float, float], ...] = ()

    @staticmethod
    def at(lon: float, lat: float, alt: float = 0.0, yaw: float = 0.0, pitch: float = 0.0, roll: float = 0.0) -> LocalFrame:
        la, ph = math.radians(lon), math.radians(lat)
        n = A / math.sqrt(1 - E2 * math.sin(ph) ** 2)
        origin = ((n + alt) * math.cos(ph) * math.cos(la), (n * (1 - E2) + alt) * math.sin(ph), -(n + alt) * math.cos(ph) * math.sin(la))
        east, north = (-math.sin(la), 0.0, -math.cos(la)), (-math.sin(ph) * math.cos(la), math.cos(ph), math.sin(ph) * math.sin(la))
        up = (math.cos(ph) * math.cos(la), math.sin(ph), -math.cos(ph) * math.sin(la))
        basis = tuple(zip(east, up, tuple(-c for c in north)))
        (cy, sy), (cx, sx), (cz, sz) = ((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (yaw, pitch, roll))
        turned = _times(_times(((cy, 0.0, sy), (0.0, 1.0, 0.0), (-sy, 0.0, cy)), ((1.0, 0.0, 0.0), (0.0, cx, -sx), (0.0, sx, cx))), ((cz, -sz, 0.0), (sz, cz, 0.0), (0.0, 0.0, 1.0)))
        return LocalFrame(origin, _times(basis, turned), basis)

    def point_to_local(self, v: Vector) -> Vector:
        d = tuple(c - F.lit(o) for c, o in zip(v, self.origin))
        return tuple(dot(d, tuple(F.lit(row[k]) for row in self.to_tile)) for k in range(3))

    def point_to_tile(self, v: Vector) -> Vector:
        return tuple(F.lit(o) + dot(v, tuple(F.lit(c) for c in row)) for o, row in zip(self.origin, self.to_tile))

    def direction_to_local(self, east: Column, north: Column, up: Column) -> Vector:
        """A direction given by east, north and up at the origin, on the frame's turned axes; nothing is moved."""
        on_tile = tuple(dot((east, up, -north), tuple(F.lit(c) for c in row)) for row in self.basis)
        return tuple(dot(on_tile, tuple(F.lit(row[k]) for row in self.to_tile)) for k in range(3))

    def root_position(self) -> tuple[float, float, float]:
        return tuple(-sum(self.to_tile[k][c] * self.origin[k] for k in range(3)) for c in range(3))

    def quaternion(self) -> tuple[float, float, float, float]:
        """(x, y, z, w) of the turn from tile axes to local ones; w is positive where the trace is, else the largest of the others."""
        m = tuple(zip(*self.to_tile))
        t = m[0][0] + m[1][1] + m[2][2]
        if t > 0:
            s = math.sqrt(max(t + 1, 0)) * 2
            return (m[2][1] - m[1][2]) / s, (m[0][2] - m[2][0]) / s, (m[1][0] - m[0][1]) / s, s / 4
        i = max(range(3), key=lambda k: m[k][k])
        j, h = (i + 1) % 3, (i + 2) % 3
        s = math.sqrt(max(1 + m[i][i] - m[j][j] - m[h][h], 0)) * 2
        q = [0.0] * 3
        q[i], q[j], q[h] = s / 4, (m[i][j] + m[j][i]) / s, (m[i][h] + m[h][i]) / s
        return q[0], q[1], q[2], (m[h][j] - m[j][h]) / s


def _times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def corners(center: Vector, axes: tuple[Vector, Vector, Vector]) -> Column:
    """The eight corners of an oriented box as an array of structs."""
    signs = [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    return F.array(*[F.struct(*[(center[k] + a * axes[0][k] + b * axes[1][k] + c * axes[2][k]).alias("xyz"[k]) for k in range(3)]) for a, b, c in signs])


def ease(n: Column) -> Column:
    """Quintic ease of a number in [0, 1]."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)) - 1
    return c * c * c * c * c + 1


def affine(m: list[float], v: Vector) -> Vector:
    """A point under a column-major 4 x 4 matrix."""
    return tuple(v[0] * m[r] + v[1] * m[4 + r] + v[2] * m[8 + r] + m[12 + r] for r in range(3))
