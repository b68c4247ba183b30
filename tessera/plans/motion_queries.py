"""Queries over cameras, movers and the estimates that depend on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import motion as M
from ..operators import folds
from .fixtures import FRAMES, PLACED, duck, table, view
from .registry import query
from .spatial_queries import _MOVING, _SESSION_FRAMES, _camera_sql, _moving, _session_frames, placed

_ORIGIN = (21.7346, 38.2466)
_LAM, _PHI = (math.radians(a) for a in _ORIGIN)


@query(f"""WITH u AS (SELECT tile_id, x / r AS ux, y / r AS uy, z / r AS uz, sqrt(x * x + z * z) / r AS flat FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM ({duck(PLACED)}) p) q)
SELECT tile_id, round(-uz / flat, 6) + 0 AS right_x, round(ux / flat, 6) + 0 AS right_z, round(uy, 6) + 0 AS up_y, round(-ux * uy / flat, 6) + 0 AS forward_x, round(flat, 6) + 0 AS forward_y FROM u""")
def b17_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right, up and forward of one who stands on a tile."""
    right, up, forward = M.spherical_basis((F.col("x"), F.col("y"), F.col("z")))
    found = {"right_x": right[0], "right_z": right[2], "up_y": up[1], "forward_x": forward[0], "forward_y": forward[1]}
    return placed(spark, sf_dir).select("tile_id", *[(F.round(c, 6) + 0).alias(n) for n, c in found.items()])


_LOCAL = f"SELECT event_id, value AS px, CAST(event_id % 50 AS DOUBLE) AS py, CAST(event_id % 17 AS DOUBLE) - 8 AS pz FROM ({FRAMES}) f"
_SL, _CL, _SP, _CP = math.sin(_LAM), math.cos(_LAM), math.sin(_PHI), math.cos(_PHI)
_OX, _OY, _OZ = G.LocalFrame.at(*_ORIGIN).origin


@query(f"""SELECT event_id, round({_OX!r} + px * {-_SL!r} + py * {_CP * _CL!r} + pz * {_SP * _CL!r}, 4) AS x, round({_OY!r} + py * {_SP!r} - pz * {_CP!r}, 4) AS y, round({_OZ!r} - px * {_CL!r} - py * {_CP * _SL!r} - pz * {_SP * _SL!r}, 4) AS z,
  round(px * {-_SL!r} + pz * {_SP * _CL!r} + py * {_CP * _CL!r}, 4) AS vx FROM ({_LOCAL}) l""")
def b13_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera poses of a local frame in tile axes; directions are turned only."""
    p = (F.col("px"), F.col("py"), F.col("pz"))
    at, vel = M.pose_to_tile(G.LocalFrame.at(*_ORIGIN), p, p)
    return view(spark, sf_dir, _LOCAL).select("event_id", F.round(at[0], 4).alias("x"), F.round(at[1], 4).alias("y"), F.round(at[2], 4).alias("z"), F.round(vel[0], 4).alias("vx"))


_WALKERS = f"SELECT event_id, {_ORIGIN[0]!r} + (event_id % 100 - 50) / 1e4 AS lon, {_ORIGIN[1]!r} + (event_id % 70 - 35) / 1e4 AS lat, event_id % 628 / 1e2 AS heading, value AS metres FROM ({FRAMES}) f"
_EAST = M.METRES_PER_DEGREE * math.cos(_PHI)


@query(f"""WITH s AS (SELECT event_id, heading, lon + sin(heading) * metres / {_EAST!r} AS lon, lat + cos(heading) * metres / 111320e0 AS lat FROM ({_WALKERS}) w), o AS (SELECT *, (lon - {_ORIGIN[0]!r}) * {_EAST!r} AS e, (lat - {_ORIGIN[1]!r}) * 111320e0 AS n FROM s)
SELECT event_id, round(lon, 9) AS lon, round(lat, 9) AS lat, round(CASE WHEN sqrt(e * e + n * n) > 300 THEN atan2(-e, -n) ELSE heading END, 6) AS heading FROM o""")
def b19_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of each walker, and the turn back of those who went too far."""
    lon, lat, heading = M.walk(F.col("lon"), F.col("lat"), F.col("heading"), F.col("metres"), _ORIGIN, 300.0)
    return view(spark, sf_dir, _WALKERS).select("event_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"), F.round(heading, 6).alias("heading"))


_GESTURES = f"SELECT event_id, CAST(event_id % 360 AS DOUBLE) AS heading, CAST(event_id % 130 - 20 AS DOUBLE) AS pitch, value * 10 AS distance, event_id % 5 * 40e0 AS apart, event_id % 3 * 60e0 AS apart_after, event_id % 628 / 1e2 - 3.14 AS angle, event_id % 314 / 5e1 - 3.14 AS angle_after FROM ({FRAMES}) f"


@query(f"""WITH g AS (SELECT event_id, heading - degrees(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END) AS h, radians(greatest(-10e0, least(85e0, pitch))) AS p,
  greatest(5e0, least(1e5, CASE WHEN apart > 0 AND apart_after > 0 THEN distance * apart / apart_after ELSE distance END)) AS far FROM (SELECT *, angle_after - angle AS d FROM ({_GESTURES}) q) s)
SELECT event_id, round(h, 6) AS heading, round(sin(radians(h)) * cos(p) * far, 4) AS east, round(-cos(radians(h)) * cos(p) * far, 4) AS north, round(sin(p) * far, 4) AS up FROM g""")
def b20_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbits after a gesture of two fingers, their pitch and distance held in limits."""
    heading = M.twisted(F.col("heading"), F.col("angle"), F.col("angle_after"))
    east, north, up = M.orbit(heading, F.col("pitch"), M.pinched(F.col("distance"), F.col("apart"), F.col("apart_after")))
    return view(spark, sf_dir, _GESTURES).select("event_id", F.round(heading, 6).alias("heading"), F.round(east, 4).alias("east"), F.round(north, 4).alias("north"), F.round(up, 4).alias("up"))


_PATH = [(0.0, 100.0, 0.0), (300.0, 120.0, 40.0), (500.0, 90.0, -60.0), (100.0, 300.0, 10.0)]


def _axis_sql(k: int) -> str:
    low, high = (f"[{', '.join(f'{p[k]!r}' for p in points)}][1 + stretch]" for points in (_PATH[:-1], _PATH[1:]))
    return f"round(CAST({low} + ({high} - {low}) * (pos - stretch) AS DOUBLE), 4)"


@query(f"""WITH e AS (SELECT session_id, frame_no, sum(greatest(0, value)) OVER (PARTITION BY session_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS ms FROM ({FRAMES}) f), a AS (SELECT *, least(1e0, ms / 500) AS progress, least(1e0, ms / 500) * 3 AS pos FROM e),
s AS (SELECT *, CAST(least(2, floor(pos)) AS INTEGER) AS stretch FROM a) SELECT session_id, frame_no, round(progress, 6) AS progress, round(pow(progress - 1, 5) + 1, 6) AS eased, {_axis_sql(0)} AS x, {_axis_sql(1)} AS y, {_axis_sql(2)} AS z, progress >= 1 AS finished FROM s""")
def b22_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a flight along waypoints is in each frame, by the time that its frames took."""
    elapsed = F.sum(F.greatest(F.lit(0.0), F.col("value"))).over(Window.partitionBy("session_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0))
    f = view(spark, sf_dir, FRAMES).withColumn("progress", F.least(F.lit(1.0), elapsed / 500))
    x, y, z = M.along(_PATH, F.col("progress"))
    return f.select("session_id", "frame_no", F.round("progress", 6).alias("progress"), F.round(G.ease(F.col("progress")), 6).alias("eased"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"), (F.col("progress") >= 1).alias("finished"))


#: Walks of the tree that an almost still camera skips: at most ten in a row, and none once it has moved two metres.
_STILL = "(a.walked > 0 AND a.skipped < 10 AND (b.cam_x - a.x) * (b.cam_x - a.x) + (b.cam_z - a.z) * (b.cam_z - a.z) < 4e0)"
IDLE = folds.Machine(
    fields=(
        ("x", "DOUBLE", "0", f"CASE WHEN {_STILL} THEN a.x ELSE b.cam_x END"), ("z", "DOUBLE", "0", f"CASE WHEN {_STILL} THEN a.z ELSE b.cam_z END"),
        ("skipped", "BIGINT", "0", f"CASE WHEN {_STILL} THEN a.skipped + 1 ELSE 0 END"), ("walked", "BIGINT", "0", f"a.walked + CASE WHEN {_STILL} THEN 0 ELSE 1 END"), ("idle", "BIGINT", "0", f"a.idle + CASE WHEN {_STILL} THEN 1 ELSE 0 END"),
    ),
    inputs=(("cam_x", "DOUBLE"), ("cam_z", "DOUBLE")),
)
_CREEP = f"SELECT session_id, frame_no, event_id % 23 / 1e1 AS cam_x, event_id % 19 / 1e1 AS cam_z FROM ({FRAMES}) f"


@query(IDLE.duck(_CREEP, "session_id", "frame_no"))
def c19_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of the tree that were done and skipped by cameras that hardly move."""
    return IDLE.run(view(spark, sf_dir, _CREEP), "session_id", ["frame_no"])


_PREPARATION = """WITH r AS (SELECT k.event_id, k.tile_id, df / greatest(d, 1e-6) AS ahead, dv / (greatest(d, 1e-6) * greatest(s, 1e-6)) AS travel FROM k)
SELECT event_id, tile_id, round(CASE WHEN tile_id % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN tile_id % 5 = 0 THEN 6 ELSE 0 END + 2 * ahead + 2.5 * travel - CASE WHEN ahead < -0.2 THEN 3 ELSE 0 END, 6) AS score FROM r"""


def _prepared(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({f"d{k}": F.col(k) - F.col(f"c{k}") for k in "xyz"})
    to, vel, cam = (tuple(F.col(n) for n in names) for names in (("dx", "dy", "dz"), ("vx", "vy", "vz"), ("cx", "cy", "cz")))
    forward = tuple(-c / G.length(cam) for c in cam)
    score = M.preparation_score(to, vel, forward, F.col("tile_id") % 3 == 0, F.col("tile_id") % 5 == 0)
    return rows.select("event_id", "tile_id", F.round(score, 6).alias("score"))


@query(_PREPARATION.replace("WITH r", f"WITH {_MOVING}, r"))
def d4_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 on a sample, every tenth frame and the nations' tiles: see d4_session_preparation for all."""
    return _prepared(_moving(spark, sf_dir))


@query(_PREPARATION.replace("WITH r", f"WITH {_SESSION_FRAMES}, r"))
def d4_session_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which loaded tiles moving cameras want prepared first, all frames and all tiles that their sessions hold."""
    return _prepared(_session_frames(spark, sf_dir))


@query("""WITH t AS (SELECT l_partkey AS mesh_id, sum(w * h * CASE WHEN mips THEN 16 ELSE 12 END) AS thirds FROM (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS w, l_linenumber * 16 AS h, l_orderkey % 4 > 0 AS mips FROM lineitem) GROUP BY l_partkey),
b AS (SELECT l_partkey AS mesh_id, sum(n) AS n_bytes FROM (SELECT l_partkey, l_suppkey, max(CAST(l_suppkey * 12 AS BIGINT)) AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey)
SELECT mesh_id, CAST((thirds + 2) // 3 + n_bytes AS BIGINT) AS gpu_bytes FROM t JOIN b USING (mesh_id)""")
def d7_gpu_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mesh takes on a GPU: its textures, a third more with mipmaps, and each of its buffers once."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mesh_id"), F.col("l_quantity").cast("long").alias("w"), (F.col("l_linenumber") * 16).alias("h"), (F.col("l_orderkey") % 4 > 0).alias("mips"), "l_suppkey")
    # Sums by buffer first, so that one shuffle by mesh counts texels of all rows and bytes of each buffer once.
    by_buffer = line.groupBy("mesh_id", "l_suppkey").agg(F.sum(F.col("w") * F.col("h") * F.when(F.col("mips"), 16).otherwise(12)).alias("thirds"), F.max(F.col("l_suppkey") * 12).cast("long").alias("n_bytes"))
    found = by_buffer.groupBy("mesh_id").agg(F.sum("thirds").alias("thirds"), F.sum("n_bytes").alias("n_bytes"))
    return found.select("mesh_id", (F.expr("(thirds + 2) div 3") + F.col("n_bytes")).alias("gpu_bytes"))


@query("""WITH p AS (SELECT c_nationkey AS ring_id, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 89 AS DOUBLE) AS z FROM customer), c AS (SELECT ring_id, avg(x) AS cx, avg(z) AS cz FROM p GROUP BY ring_id)
SELECT ring_id, count(*) AS vertices, round(any_value(cx), 6) AS x, round(any_value(cz), 6) AS z, round(0.4 * avg(sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz))), 6) AS radius FROM p JOIN c USING (ring_id) GROUP BY ring_id""")
def f15_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hole of a polygon, about the mean of its vertices, with two fifths of their mean distance."""
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("ring_id"), (F.col("c_custkey") % 97).cast("double").alias("x"), (F.col("c_custkey") % 89).cast("double").alias("z"))
    center = p.groupBy("ring_id").agg(F.avg("x").alias("cx"), F.avg("z").alias("cz"), F.count(F.lit(1)).alias("vertices"))
    far = F.hypot(F.col("x") - F.col("cx"), F.col("z") - F.col("cz"))
    found = p.join(center, "ring_id").groupBy("ring_id").agg(F.first("vertices").alias("vertices"), F.first("cx").alias("x"), F.first("cz").alias("z"), F.avg(far).alias("mean"))
    return found.select("ring_id", "vertices", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"), F.round(0.4 * F.col("mean"), 6).alias("radius"))


@query(f"""WITH q AS (SELECT event_id, event_id % 200 / 1e2 - 1 AS turn, value AS px FROM ({FRAMES}) f)
SELECT event_id, round(10 + cos(turn) * px * 2 + sin(turn) * 3, 5) AS x, round(20 + 0.5e0, 5) AS y, round(30 - sin(turn) * px * 2 + cos(turn) * 3, 5) AS z FROM q""")
def b21_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of nodes that are scaled, turned about the upright axis, and moved."""
    f = view(spark, sf_dir, FRAMES).withColumn("turn", F.col("event_id") % 200 / 1e2 - 1)
    zero, half = F.lit(0.0), F.col("turn") / 2
    x, y, z = M.place((F.col("value"), F.lit(0.25), F.lit(1.0)), (F.lit(10.0), F.lit(20.0), F.lit(30.0)), (zero, F.sin(half), zero, F.cos(half)), (F.lit(2.0), F.lit(2.0), F.lit(3.0)))
    return f.select("event_id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(z, 5).alias("z"))


_TURNS = f"SELECT event_id, event_id % 3 AS axis, (event_id % 311 - 155) / 5e1 AS turn FROM ({FRAMES}) f"


@query(f"""SELECT event_id, round(CASE WHEN axis = 0 THEN sin(turn / 2) ELSE 0e0 END, 6) + 0 AS x, round(CASE WHEN axis = 1 THEN sin(turn / 2) ELSE 0e0 END, 6) + 0 AS y, round(CASE WHEN axis = 2 THEN sin(turn / 2) ELSE 0e0 END, 6) + 0 AS z, round(cos(turn / 2), 6) + 0 AS w FROM ({_TURNS}) t""")
def b6_quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternions of turns about each axis, with a positive w."""
    c, s, axis = F.cos("turn"), F.sin("turn"), F.col("axis")

    def by(x: object, y: object, z: object):  # type: ignore[no-untyped-def]
        return F.when(axis == 0, x).when(axis == 1, y).otherwise(z)

    m = ((by(1.0, c, c), by(0.0, 0.0, -s), by(0.0, s, 0.0)), (by(0.0, 0.0, s), by(c, 1.0, c), by(-s, 0.0, 0.0)), (by(0.0, -s, 0.0), by(s, 0.0, 0.0), by(c, c, 1.0)))
    q = M.quaternion(m)
    sign = F.when(q[3] < 0, -1.0).otherwise(1.0)
    return view(spark, sf_dir, _TURNS).select("event_id", *[(F.round(v * sign, 6) + 0).alias(n) for n, v in zip("xyzw", q)])


@query(f"""WITH f AS (SELECT session_id, frame_no, value AS x, event_id % 90 * 1e0 AS z, epoch_us(ts) // 1000 AS ms FROM ({FRAMES}) q), d AS (SELECT session_id, frame_no, greatest(1e-3, (ms - lag(ms) OVER w) / 1e3) AS s, x - lag(x) OVER w AS dx, z - lag(z) OVER w AS dz FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_no))
SELECT session_id, frame_no, round(sqrt(dx / s * (dx / s) + dz / s * (dz / s)), 9) AS speed FROM d WHERE dx IS NOT NULL""")
def g18_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speed of cameras that don't tell it, from where they were."""
    f = view(spark, sf_dir, FRAMES).select("session_id", "frame_no", F.col("value").alias("x"), (F.col("event_id") % 90 * 1.0).alias("z"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    w = Window.partitionBy("session_id").orderBy("frame_no")
    f = f.withColumns({f"before_{c}": F.lag(c).over(w) for c in ("x", "z", "ms")})
    v = M.velocity((F.col("x"), F.lit(0.0), F.col("z")), (F.col("before_x"), F.lit(0.0), F.col("before_z")), F.col("ms"), F.col("before_ms"))
    return f.where("before_x is not null").select("session_id", "frame_no", F.round(G.length(v), 9).alias("speed"))


@query(f"SELECT event_id, round(cx, 3) AS x, round(cy, 3) AS y, round(cz, 3) AS z, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT *, {_camera_sql('lon', 'lat', 'alt')} FROM ({FRAMES}) f) q")
def b15_teleports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a teleport puts the camera, and the place that is read out there."""
    f = view(spark, sf_dir, FRAMES)
    x, y, z = G.to_tile(F.col("lon"), F.col("lat"), F.col("alt"))
    f = f.select("event_id", x.alias("x"), y.alias("y"), z.alias("z"))
    lon, lat, _ = G.to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return f.select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("z", 3).alias("z"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))
