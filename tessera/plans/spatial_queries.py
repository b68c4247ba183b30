"""Queries over positions, views and trees of tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import tiles as T
from ..operators import hierarchy as H
from ..operators import holds
from .fixtures import FRAMES, PLACED, TILE_TABLE, TILES, duck, table, view
from .registry import query

FOV, HEIGHT = math.pi / 3, 1000.0
#: The camera of single-frame queries: above this place, at this height, looking down.
CAMERA = (21.7346, 38.2466, 900000.0)
_P = duck(PLACED)


def _camera_sql(lon: str, lat: str, alt: str) -> str:
    """x, y, z on tile axes."""
    n = f"(6378137e0 / sqrt(1 - 0.0066943799901413165e0 * sin(radians({lat})) * sin(radians({lat}))))"
    return f"({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})) AS cx, ({n} * (1 - 0.0066943799901413165e0) + {alt}) * sin(radians({lat})) AS cy, -({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})) AS cz"


def placed(spark: SparkSession, sf_dir: str, depth: int = 4) -> DataFrame:
    """The tiles with their centres x, y, z on tile axes."""
    t = view(spark, sf_dir, TILE_TABLE).where(F.col("depth") <= depth)
    x, y, z = G.to_tile(F.col("lon"), F.col("lat"), F.lit(0.0))
    return t.withColumns({"x": x, "y": y, "z": z})


def _near(rows: DataFrame) -> DataFrame:
    """Adds the single camera's position and the distance to it."""
    c = G.to_tile(*(F.lit(v) for v in CAMERA))
    rows = rows.withColumns({"cx": c[0], "cy": c[1], "cz": c[2]})
    return rows.withColumn("dist", G.length((F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("z") - F.col("cz"))))


_NEAR = f"near AS (SELECT p.*, c.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS dist FROM ({_P}) p, (SELECT {_camera_sql(str(CAMERA[0]), str(CAMERA[1]), str(CAMERA[2]))}) c)"
_SSE = f"coalesce(ge * 1000e0 / (greatest(dist, 1e-7) * 2 * tan({FOV!r} / 2)), 0)"


@query(f"SELECT tile_id, round(x, 3) AS ecef_x, round(-z, 3) AS ecef_y, round(y, 3) AS ecef_z, round(x + half, 3) AS corner_x FROM ({_P}) p")
def b1_geodetic_to_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECEF centres, and one corner of the boxes."""
    t = view(spark, sf_dir, TILE_TABLE)
    e = G.to_ecef(F.col("lon"), F.col("lat"), F.lit(0.0))
    zero = F.lit(0.0)
    box = G.corners(e, ((F.col("half"), zero, zero), (zero, F.col("half"), zero), (zero, zero, F.col("half"))))
    return t.select("tile_id", F.round(e[0], 3).alias("ecef_x"), F.round(e[1], 3).alias("ecef_y"), F.round(e[2], 3).alias("ecef_z"), F.round(box[7]["x"], 3).alias("corner_x"))


@query(f"SELECT tile_id, round(lon, 6) AS lon, round(lat, 6) AS lat, 0e0 AS alt FROM ({duck(TILE_TABLE)}) t")
def b2_tile_to_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from tile positions; altitudes to the decimetre."""
    lon, lat, alt = G.to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return placed(spark, sf_dir).select("tile_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), F.abs(F.round(alt, 1)).alias("alt"))


@query(f"""
WITH o AS (SELECT {_camera_sql("21.7346", "38.2466", "0")}, radians(21.7346) AS la, radians(38.2466) AS ph), d AS (SELECT tile_id, x - cx AS dx, y - cy AS dy, z - cz AS dz, la, ph FROM ({_P}) p, o)
SELECT tile_id, round(-sin(la) * dx - cos(la) * dz, 2) AS east, round(cos(ph) * cos(la) * dx + sin(ph) * dy - cos(ph) * sin(la) * dz, 2) AS up,
  round(sin(ph) * cos(la) * dx - cos(ph) * dy - sin(ph) * sin(la) * dz, 2) AS south, round(sqrt(dx * dx + dy * dy + dz * dz), 2) AS far FROM d""")
def b7_local_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile centres in a local frame."""
    frame = G.LocalFrame.at(21.7346, 38.2466)
    v = frame.point_to_local((F.col("x"), F.col("y"), F.col("z")))
    return placed(spark, sf_dir).select("tile_id", F.round(v[0], 2).alias("east"), F.round(v[1], 2).alias("up"), F.round(v[2], 2).alias("south"), F.round(G.length(v), 2).alias("far"))


@query(f"""
WITH {_NEAR}, s AS (SELECT *, {_SSE} AS sse, sqrt(cx * cx + cy * cy + cz * cz) AS cl FROM near)
SELECT tile_id, round(sse, 4) AS sse, -(x * cx + y * cy + z * cz) / cl + cl >= -sqrt(3 * half * half) AS in_view, sse > 16 AS refine, sse = 0 OR sse <= 128 AS usable, sse = 0 OR sse <= 48 AS preload,
  (x * x + y * y + z * z <= 0.01 * cl * cl) OR (x * cx + y * cy + z * cz >= 0 AND (x * cx + y * cy + z * cz) * (x * cx + y * cy + z * cz) >= 0.04 * cl * cl * (x * x + y * y + z * z)) AS in_cone FROM s""")
def c1_view_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frustum, refinement, globe cone, usable ancestor, preload gate and screen-space error."""
    rows = _near(placed(spark, sf_dir))
    cl = G.length((F.col("cx"), F.col("cy"), F.col("cz")))
    v, c = (F.col("x"), F.col("y"), F.col("z")), (F.col("cx"), F.col("cy"), F.col("cz"))
    error = T.sse(F.col("ge"), F.col("dist"), FOV, HEIGHT)
    ahead = -G.dot(v, c) / cl + cl >= -F.sqrt(3 * F.col("half") * F.col("half"))  # the plane through the camera, facing down
    return rows.select("tile_id", F.round(error, 4).alias("sse"), ahead.alias("in_view"), T.refines(F.col("ge"), F.col("dist"), FOV, HEIGHT).alias("refine"), T.usable_ancestor(F.col("ge"), F.col("dist"), FOV, HEIGHT).alias("usable"), T.preloads(error).alias("preload"), T.in_cone(v, c, 0.2).alias("in_cone"))


def _flown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames, with the camera's position and velocity on tile axes."""
    f = view(spark, sf_dir, FRAMES)
    c = G.to_tile(F.col("lon"), F.col("lat"), F.col("alt"))
    w = Window.partitionBy("session_id").orderBy("frame_no")
    f = f.withColumns({"cx": c[0], "cy": c[1], "cz": c[2]})
    return f.withColumns({f"v{k}": F.coalesce((F.col(f"c{k}") - F.lag(f"c{k}").over(w)) / 1e5, F.lit(0.0)) for k in "xyz"})


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' tiles against every tenth frame, a small sample: vectors to the tile, velocity and forward."""
    f = _flown(spark, sf_dir).where("event_id % 10 = 0")
    t = placed(spark, sf_dir, 2).where("depth = 2").select("tile_id", "x", "y", "z", "ge")
    return f.crossJoin(F.broadcast(t))  # the 25 tiles of the second level


def _session_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame against all tiles that its session holds: the 31 of the upper three levels, and the customer of the session's
    number (of as many as there are customers) with its orders."""
    f, t = _flown(spark, sf_dir), placed(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("customers"))
    f = f.crossJoin(F.broadcast(customers)).withColumn("owner", 1000 + F.col("session_id") % F.col("customers")).drop("customers")
    columns = ("tile_id", "x", "y", "z", "ge")
    upper = f.crossJoin(F.broadcast(t.where("depth <= 2").select(*columns)))
    own = t.where("depth > 2").select(*columns, F.when(F.col("depth") == 3, F.col("tile_id")).otherwise(F.col("parent_id")).alias("owner"))
    return upper.unionByName(f.join(own, "owner"))


_MOVING = f"""
f AS (SELECT q.*, {_camera_sql("lon", "lat", "alt")} FROM ({FRAMES}) q),
v AS (SELECT *, coalesce((cx - lag(cx) OVER w) / 1e5, 0) AS vx, coalesce((cy - lag(cy) OVER w) / 1e5, 0) AS vy, coalesce((cz - lag(cz) OVER w) / 1e5, 0) AS vz FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_no)),
m AS (SELECT v.*, p.tile_id, ge, x - cx AS dx, y - cy AS dy, z - cz AS dz, -cx / sqrt(cx * cx + cy * cy + cz * cz) AS fx, -cy / sqrt(cx * cx + cy * cy + cz * cz) AS fy, -cz / sqrt(cx * cx + cy * cy + cz * cz) AS fz FROM v, ({_P}) p WHERE event_id % 10 = 0 AND depth = 2),
a AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d, sqrt(vx * vx + vy * vy + vz * vz) AS s, dx * vx + dy * vy + dz * vz AS dv, dx * fx + dy * fy + dz * fz AS df,
  sqrt((dx - 1.5 * vx) * (dx - 1.5 * vx) + (dy - 1.5 * vy) * (dy - 1.5 * vy) + (dz - 1.5 * vz) * (dz - 1.5 * vz)) AS later FROM m),
k AS (SELECT *, s >= 2 AND dv / (greatest(d, 1e-6) * greatest(s, 1e-6)) >= 0.25 AND later < d AND df / greatest(d, 1e-6) >= -0.5 AS predicted,
  df / greatest(d, 1e-6) < -0.2 AND (s < 2 OR dv / (greatest(d, 1e-6) * greatest(s, 1e-6)) < -0.2) AS behind,
  ge * 1000e0 / (greatest(d, 1e-7) * 2 * tan({FOV!r} / 2)) AS sse, CASE WHEN s * s > 1 THEN dv / (greatest(d, 1e-6) * s) ELSE 0 END AS motion, df / greatest(d, 1e-6) AS cosine FROM a)"""


#: The same of all frames and the tiles that their sessions hold, by an equality join; -1 owns the upper levels.
_SESSION_FRAMES = _MOVING.replace(
    f"FROM v, ({_P}) p WHERE event_id % 10 = 0 AND depth = 2",
    f"FROM (SELECT *, unnest([-1, 1000 + session_id % customers]) AS owner FROM v, (SELECT count(*) AS customers FROM customer) c) v JOIN (SELECT *, CASE depth WHEN 3 THEN tile_id WHEN 4 THEN parent_id ELSE -1 END AS owner FROM ({_P}) p) p ON v.owner = p.owner",
)
_PRIORITIES = """
SELECT event_id, tile_id, predicted, behind, CASE WHEN predicted THEN 1.75e0 WHEN behind THEN 8e0 ELSE 4e0 END AS factor, CASE WHEN predicted THEN 'predicted' ELSE 'coverage' END AS request_class, CASE WHEN predicted THEN 2 ELSE 1 END AS class_rank,
  round(1 / (1 + ln(greatest(sse / 16, 1e0))) + 0.7 * greatest(0e0, cosine) + 0.3 / (1 + d * 1e-4) + 0.5 * motion - CASE WHEN cosine < 0 AND motion < 0 THEN 0.75 ELSE 0 END + CASE WHEN predicted THEN 2 ELSE 0 END, 6) AS priority FROM k"""


def _priorities(rows: DataFrame) -> DataFrame:
    to, vel, cam = (tuple(F.col(n) for n in names) for names in (("dx", "dy", "dz"), ("vx", "vy", "vz"), ("cx", "cy", "cz")))
    rows = rows.withColumns({f"d{k}": F.col(k) - F.col(f"c{k}") for k in "xyz"})
    forward = tuple(-c / G.length(cam) for c in cam)
    ahead, back = T.predicted(to, vel, forward), T.behind(to, vel, forward)
    factor, name = T.view_class(F.lit(False), ahead, back)
    error = T.sse(F.col("ge"), G.length(to), FOV, HEIGHT)
    rows = rows.select("event_id", "tile_id", ahead.alias("predicted"), back.alias("behind"), factor.alias("factor"), name.alias("request_class"), T.priority(error, to, vel, forward).alias("p"))
    return rows.select("event_id", "tile_id", "predicted", "behind", "factor", "request_class", T.class_rank(F.col("request_class")).alias("class_rank"), F.round(F.col("p") + T.class_bonus(F.col("request_class")), 6).alias("priority"))


@query(f"WITH {_MOVING}{_PRIORITIES}")
def d2_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, C5, D2, D3, D5, D10, D12 on a sample, every tenth frame and the nations' tiles: see d2_session_priorities for all."""
    return _priorities(_moving(spark, sf_dir))


@query(f"WITH {_SESSION_FRAMES}{_PRIORITIES}")
def d2_session_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction, behind the camera, request classes and priorities of moving cameras, all frames."""
    return _priorities(_session_frames(spark, sf_dir))


#: Regions in order: ring of (lon, lat) and what is done with tiles inside.
REGIONS = (
    ("pin", ((21.70, 38.20), (21.78, 38.21), (21.79, 38.27), (21.74, 38.30), (21.69, 38.26))),
    ("hide", ((-40.0, -20.0), (30.0, -20.0), (30.0, 40.0), (-40.0, 40.0))),
    ("transparent", ((-60.0, 10.0), (100.0, 10.0), (100.0, 60.0), (-60.0, 60.0))),
    ("pin", ((60.0, -50.0), (150.0, -50.0), (150.0, 5.0), (60.0, 5.0))),
)
_BOXES = [(mode, min(x for x, _ in ring), max(x for x, _ in ring), min(y for _, y in ring), max(y for _, y in ring)) for mode, ring in REGIONS]


def _polygon_sql(ring: tuple) -> str:
    tests = [f"CASE WHEN (({yi}e0 > lat) <> ({yj}e0 > lat)) AND lon < ({xj}e0 - {xi}e0) * (lat - {yi}e0) / ({yj}e0 - {yi}e0) + {xi}e0 THEN 1 ELSE 0 END" for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]) if yi != yj]
    return f"(({' + '.join(tests)}) % 2 = 1)"


_INSIDE_SQL = [f"(lon >= {a} AND lon <= {b} AND lat >= {c} AND lat <= {d} AND {_polygon_sql(ring)})" for (_, a, b, c, d), (_, ring) in zip(_BOXES, REGIONS)]
_PIN_SQL = " OR ".join(f"(lon >= {a} - half / 111000e0 AND lon <= {b} + half / 111000e0 AND lat >= {c} - half / 111000e0 AND lat <= {d} + half / 111000e0)" for mode, a, b, c, d in _BOXES if mode == "pin")


@query(f"""SELECT tile_id, CASE {' '.join(f"WHEN {inside} THEN {k}" for k, inside in enumerate(_INSIDE_SQL))} END AS region, CASE {' '.join(f"WHEN {inside} THEN '{REGIONS[k][0]}'" for k, inside in enumerate(_INSIDE_SQL))} END AS mode, ({_PIN_SQL}) AS pinned FROM ({duck(TILE_TABLE)}) t""")
def e1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region that holds a tile, and tiles near the box of a pinning one."""
    t = view(spark, sf_dir, TILE_TABLE)
    lon, lat, pad = F.col("lon"), F.col("lat"), F.col("half") / 111000
    region, mode, pinned = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(False)
    for k, (name, a, b, c, d) in reversed(list(enumerate(_BOXES))):
        inside = lon.between(a, b) & lat.between(c, d) & T.in_polygon(lon, lat, list(REGIONS[k][1]))
        region, mode = F.when(inside, k).otherwise(region), F.when(inside, name).otherwise(mode)
        if name == "pin":
            pinned = pinned | ((lon >= a - pad) & (lon <= b + pad) & (lat >= c - pad) & (lat <= d + pad))
    return t.select("tile_id", region.alias("region"), mode.alias("mode"), pinned.alias("pinned"))


@query(f"""SELECT tile_id, {_polygon_sql(REGIONS[1][1])} AND NOT (sqrt((lon - 0e0) * (lon - 0e0) + (lat - 10e0) * (lat - 10e0)) < 15) AS kept, NOT (sqrt((lon - 50e0) * (lon - 50e0) + lat * lat) < 30 OR {_polygon_sql(REGIONS[3][1])}) AS uncut,
  (52.9829189 * (g - floor(g))) - floor(52.9829189 * (g - floor(g))) < 0.5 AS dithered FROM (SELECT *, lon * 0.06711056e0 + lat * 0.00583715e0 AS g FROM ({duck(TILES)}) u) t""")
def c20_crop_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop to a polygon with a hole, cut-out zones, ordered dither."""
    t = view(spark, sf_dir, TILES)
    lon, lat = F.col("lon"), F.col("lat")
    hole = F.sqrt((lon - 0.0) * (lon - 0.0) + (lat - 10.0) * (lat - 10.0)) < 15
    zone = (F.sqrt((lon - 50.0) * (lon - 50.0) + lat * lat) < 30) | T.in_polygon(lon, lat, list(REGIONS[3][1]))
    return t.select("tile_id", (T.in_polygon(lon, lat, list(REGIONS[1][1])) & ~hole).alias("kept"), (~zone).alias("uncut"), T.dither_keep(lon, lat, F.lit(0.5), F.lit(True)).alias("dithered"))


@query(f"""WITH RECURSIVE t AS ({duck(TILES)}), w AS (SELECT tile_id, parent_id, 0 AS depth, [tile_id] AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.tile_id, t.parent_id, w.depth + 1, list_append(path, t.tile_id) FROM t JOIN w ON t.parent_id = w.tile_id)
SELECT tile_id, parent_id, depth, array_to_string(path, '/') AS path FROM w""")
def j1_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and path of every node, from parents only."""
    flat = H.flatten(view(spark, sf_dir, TILES).select("tile_id", "parent_id"))
    return flat.select("tile_id", "parent_id", "depth", F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"))


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = view(spark, sf_dir, TILE_TABLE)
    return t, H.flatten(t.select("tile_id", "parent_id"))


@query(f"SELECT tile_id, CASE WHEN depth >= 2 THEN tile_id END AS visual FROM ({duck(TILES)}) t")
def e3_visual_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest renderable ancestor or self."""
    t, paths = _paths(spark, sf_dir)
    return H.visual_ancestor(t, paths)


@query(f"WITH t AS ({duck(TILES)}) SELECT a.tile_id, b.tile_id AS above FROM t a JOIN t b ON a.parent_id = b.tile_id WHERE a.tile_id % 3 = 0 AND b.tile_id % 3 = 0 AND b.depth >= 2 UNION ALL SELECT a.tile_id, c.tile_id FROM t a JOIN t b ON a.parent_id = b.tile_id JOIN t c ON b.parent_id = c.tile_id WHERE a.tile_id % 3 = 0 AND c.tile_id % 3 = 0 AND c.depth >= 2")
def e4_coarser_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown tiles above shown tiles."""
    t, paths = _paths(spark, sf_dir)
    return H.coarser_shown(t, paths, t.where("tile_id % 3 = 0").select("tile_id"))


@query(f"WITH t AS ({duck(TILES)}) SELECT parent_id AS tile_id, tile_id AS piece FROM t WHERE depth >= 2 UNION ALL SELECT b.parent_id, a.tile_id FROM t a JOIN t b ON a.parent_id = b.tile_id WHERE b.depth = 1")
def e5_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: the replacement frontier below each tile, through the wrappers of the first level."""
    return H.frontier(view(spark, sf_dir, TILE_TABLE))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _near(placed(spark, sf_dir))
    error = T.sse(F.col("ge"), F.col("dist"), FOV, HEIGHT)
    seen = F.col("lon") > -100
    factor = F.when(seen, 1.0).otherwise(4.0)
    uri = F.when((F.col("depth") > 1) | (F.col("tile_id") == 1), F.col("uri"))  # one wrapper; the other regions have no content
    return rows.select("tile_id", "parent_id", "depth", "ord", uri.alias("uri"), "ready", seen.alias("in_view"), (error > 16 * factor).alias("refine"), T.usable_ancestor(F.col("ge"), F.col("dist"), FOV, HEIGHT).alias("usable"), T.preloads(error, factor).alias("preload"), error.alias("sse"))


def _cut_sql(mode: str) -> str:
    """The cut of the five-level tree, with every level written out."""
    parts = [f"WITH {_NEAR}, s AS (SELECT *, {_SSE} AS sse, CASE WHEN lon > -100 THEN 1e0 ELSE 4e0 END AS f FROM near)"]
    parts.append(
        "n AS (SELECT s.tile_id, s.parent_id, depth, s.tile_id = 1 AS wrapper, depth >= 2 AND ready AS shown, lon > -100 AS in_view, sse = 0 OR sse <= 128 AS usable, (depth >= 2 AND NOT ready AND (sse = 0 OR sse <= 48 * f)) OR (s.tile_id = 1 AND first IS NULL) AS asked, "
        "first, first IS NOT NULL AND (s.tile_id = 1 OR sse > 16 * f) AS opens FROM s LEFT JOIN (SELECT parent_id AS pid, min(tile_id) AS first FROM s GROUP BY parent_id) k ON k.pid = s.tile_id)"
    )
    parts.append("l0 AS (SELECT *, CAST(NULL AS BIGINT) AS fb, false AS fu FROM n WHERE depth = 0)")
    for k in range(1, 5):
        parts.append(f"l{k} AS (SELECT n.*, CASE WHEN p.shown THEN p.tile_id ELSE p.fb END AS fb, CASE WHEN p.shown THEN p.usable ELSE p.fu END AS fu FROM n JOIN l{k - 1} p ON n.parent_id = p.tile_id WHERE p.opens AND (NOT p.wrapper OR n.tile_id = p.first))")
    parts.append("g5 AS (SELECT CAST(NULL AS BIGINT) AS pid, true AS ac, false AS an WHERE false)")
    mixed = "in_view AND shown" if mode == "mixed" else "false"
    for k in range(4, -1, -1):
        parts.append(
            f"b{k} AS (SELECT l.*, ac IS NOT NULL AS walked, coalesce(ac, false) AS full_, coalesce(an, false) AS some_, CASE WHEN shown THEN tile_id ELSE fb END AS nx, CASE WHEN shown THEN usable ELSE fu END AS nu FROM l{k} l LEFT JOIN g{k + 1} g ON g.pid = l.tile_id), "
            f"c{k} AS (SELECT *, walked AND NOT wrapper AS inner_, walked AND NOT wrapper AND NOT full_ AND some_ AND {mixed} AS both_, walked AND NOT wrapper AND NOT full_ AND NOT some_ AND nx IS NOT NULL AND nu AS falls FROM b{k}), "
            f"d{k} AS (SELECT *, CASE WHEN inner_ THEN in_view ELSE true END AS commit_, CASE WHEN wrapper THEN full_ WHEN inner_ THEN full_ OR both_ OR falls ELSE shown END AS covered, "
            f"CASE WHEN both_ OR (NOT walked AND NOT wrapper AND shown AND in_view) THEN tile_id WHEN falls AND in_view THEN nx END AS item, inner_ AND NOT full_ AND in_view AND NOT both_ AND NOT falls AS gap FROM c{k}), "
            f"g{k} AS (SELECT parent_id AS pid, bool_and(covered) AS ac, bool_or(item IS NOT NULL OR (some_ AND commit_)) AS an FROM d{k} GROUP BY parent_id)"
        )
    parts.append("p0 AS (SELECT *, true AS passes FROM d0)")
    for k in range(1, 5):
        parts.append(f"p{k} AS (SELECT d.*, p.passes AND p.commit_ AS passes FROM d{k} d JOIN p{k - 1} p ON d.parent_id = p.tile_id)")
    every = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(5))
    return ", ".join(parts) + f" SELECT DISTINCT item AS tile_id, 'selected' AS role FROM ({every}) WHERE passes AND item IS NOT NULL UNION ALL SELECT tile_id, 'requested' FROM ({every}) WHERE asked UNION ALL SELECT tile_id, 'gap' FROM ({every}) WHERE gap"


@query(_cut_sql("legacy"))
def select_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut that shows every ready piece and counts gaps."""
    return H.select_cut(_scored(spark, sf_dir), "legacy")


@query(_cut_sql("mixed"))
def select_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut that shows a ready parent under its ready descendants."""
    return H.select_cut(_scored(spark, sf_dir), "mixed")


@query()
def select_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut that holds a parent until its whole frontier is ready; tested on small trees."""
    return H.select_cut(_scored(spark, sf_dir), "atomic")


@query()
def select_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut that holds a parent near the wanted detail while finer tiles arrive; tested on small trees."""
    tiles = _scored(spark, sf_dir)
    tiles = tiles.withColumn("may_hold", holds.may_hold(F.col("in_view"), F.col("ready"), F.col("sse"), F.lit(True))).withColumn("dead", F.col("tile_id") % 41 == 0)
    return H.select_cut(tiles, "wave")


_CELLS = "(SELECT CAST(p_partkey AS DOUBLE) AS k, CAST(p_partkey % 40 AS DOUBLE) AS gx, CAST(p_partkey // 40 AS DOUBLE) AS gz, CAST(p_size AS DOUBLE) AS gy, CAST(p_partkey AS BIGINT) AS mesh_id FROM part)"


@query(f"""WITH m AS (SELECT * FROM {_CELLS}), p AS (SELECT event_id, event_id % 400 / 10e0 + 0.05 AS px, event_id % 370 / 10e0 + 0.02 AS pz FROM events),
h AS (SELECT event_id, gy AS height, mesh_id, 0.0e0 + 1 AS volume FROM p JOIN m ON px >= gx AND px <= gx + 1 AND pz >= gz AND pz <= gz + 1)
SELECT event_id, first(height ORDER BY volume, mesh_id) AS height, first(mesh_id ORDER BY volume, mesh_id) AS mesh_id FROM h GROUP BY event_id""")
def e9_ground_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays from above against triangles of meshes one cell wide; see e9_lod_samples for meshes of several sizes."""
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(k.cast("long").alias("mesh_id"), (k % 40).cast("double").alias("gx"), F.floor(k / 40).cast("double").alias("gz"), F.col("p_size").cast("double").alias("gy"))
    points = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 400 / 10.0 + 0.05).alias("px"), (F.col("event_id") % 370 / 10.0 + 0.02).alias("pz"))
    # An equality join on the grid cell stands for the box test; points on an edge belong to two cells.
    cells = points.withColumn("cx", F.explode(F.array_distinct(F.array(F.floor("px"), F.ceil("px") - 1)))).withColumn("cz", F.explode(F.array_distinct(F.array(F.floor("pz"), F.ceil("pz") - 1))))
    near = cells.join(m.where("1 <= 1e9"), (F.col("cx") == F.col("gx")) & (F.col("cz") == F.col("gz")))
    x0, x1, z0, z1, y = F.col("gx"), F.col("gx") + 1, F.col("gz"), F.col("gz") + 1, F.col("gy")
    origin, down = (F.col("px"), F.lit(2000.0), F.col("pz")), (F.lit(0.0), F.lit(-1.0), F.lit(0.0))
    t = F.least(T.ray_triangle(origin, down, (x0, y, z0), (x1, y, z0), (x0, y, z1)), T.ray_triangle(origin, down, (x1, y, z1), (x1, y, z0), (x0, y, z1)))
    hits = near.withColumn("t", t).where("t is not null").groupBy("event_id", "mesh_id").agg(F.min("t").alias("t"))
    return hits.groupBy("event_id").agg(F.min_by(F.struct((2000.0 - F.col("t")).alias("height"), "mesh_id"), F.struct(F.lit(1.0), F.col("mesh_id"))).alias("b")).select("event_id", "b.height", "b.mesh_id")


#: Largest product of half-extents of a mesh whose hits count.
MOST_VOLUME = 1e9


def finest_hits(points: DataFrame, meshes: DataFrame) -> DataFrame:
    """Columns event_id, height, mesh_id, volume: of the meshes under each point (px, pz) the one of least box.

    Meshes: mesh_id, their box x0 to z1, and y, where two triangles span the box.  A mesh goes to all cells that its box touches,
    on the grid whose cells are at least as wide; so it takes four cells at most, and a point looks in one cell of each grid.
    """
    volume = (F.col("x1") - F.col("x0")) / 2 * ((F.col("y1") - F.col("y0")) / 2) * ((F.col("z1") - F.col("z0")) / 2)
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0"), F.lit(1.0))
    m = meshes.withColumn("volume", volume).where(F.col("volume") <= MOST_VOLUME).withColumn("cell", F.pow(F.lit(2.0), F.ceil(F.log2(wide))))

    def covered(axis: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(f"{axis}0") / F.col("cell")), F.floor(F.col(f"{axis}1") / F.col("cell"))))

    placed_ = m.withColumn("gx", covered("x")).withColumn("gz", covered("z"))
    probes = points.crossJoin(F.broadcast(m.select("cell").distinct())).withColumns({"gx": F.floor(F.col("px") / F.col("cell")), "gz": F.floor(F.col("pz") / F.col("cell"))})
    near = probes.join(placed_, ["cell", "gx", "gz"]).where("px between x0 and x1 and pz between z0 and z1")
    x0, x1, z0, z1, y = (F.col(n) for n in ("x0", "x1", "z0", "z1", "y"))
    origin, down = (F.col("px"), F.lit(2000.0), F.col("pz")), (F.lit(0.0), F.lit(-1.0), F.lit(0.0))
    t = F.least(T.ray_triangle(origin, down, (x0, y, z0), (x1, y, z0), (x0, y, z1)), T.ray_triangle(origin, down, (x1, y, z1), (x1, y, z0), (x0, y, z1)))
    hits = near.withColumn("t", t).where("t is not null")
    best = F.min_by(F.struct((2000.0 - F.col("t")).alias("height"), "mesh_id", "volume"), F.struct("volume", "mesh_id")).alias("b")
    return hits.groupBy("event_id").agg(best).select("event_id", "b.height", "b.mesh_id", "b.volume")


_COARSE = 1_000_000_000


@query(f"""WITH c AS (SELECT * FROM {_CELLS}), m AS (SELECT mesh_id, gx AS x0, gx + 1 AS x1, gy - 0.5 AS y0, gy + 0.5 AS y1, gz AS z0, gz + 1 AS z1, gy AS y FROM c
UNION ALL SELECT CAST({_COARSE} + floor(gz / 4) * 10 + floor(gx / 4) AS BIGINT), floor(gx / 4) * 4, floor(gx / 4) * 4 + 4, min(gy) - 0.5, max(gy) + 0.5, floor(gz / 4) * 4, floor(gz / 4) * 4 + 4, min(gy) FROM c GROUP BY floor(gx / 4), floor(gz / 4)),
p AS (SELECT event_id, event_id % 400 / 10e0 + 0.05 AS px, event_id % 370 / 10e0 + 0.02 AS pz FROM events),
h AS (SELECT event_id, y AS height, mesh_id, (x1 - x0) / 2 * ((y1 - y0) / 2) * ((z1 - z0) / 2) AS volume FROM p JOIN m ON px >= x0 AND px <= x1 AND pz >= z0 AND pz <= z1)
SELECT event_id, first(height ORDER BY volume, mesh_id) AS height, first(mesh_id ORDER BY volume, mesh_id) AS mesh_id, min(volume) AS volume FROM h WHERE volume <= 1e9 GROUP BY event_id""")
def e9_lod_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays from above against cells and their coarse copies of 4 by 4 cells; of the hits the one of least box."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(k.cast("long").alias("mesh_id"), (k % 40).cast("double").alias("gx"), F.floor(k / 40).cast("double").alias("gz"), F.col("p_size").cast("double").alias("gy"))
    fine = c.select("mesh_id", F.col("gx").alias("x0"), (F.col("gx") + 1).alias("x1"), (F.col("gy") - 0.5).alias("y0"), (F.col("gy") + 0.5).alias("y1"), F.col("gz").alias("z0"), (F.col("gz") + 1).alias("z1"), F.col("gy").alias("y"))
    blocks = c.groupBy(F.floor(F.col("gx") / 4).alias("bx"), F.floor(F.col("gz") / 4).alias("bz")).agg(F.min("gy").alias("low"), F.max("gy").alias("high"))
    x, z = (F.col(b).cast("double") * 4 for b in ("bx", "bz"))
    coarse = blocks.select((F.col("bz") * 10 + F.col("bx") + _COARSE).alias("mesh_id"), x.alias("x0"), (x + 4).alias("x1"), (F.col("low") - 0.5).alias("y0"), (F.col("high") + 0.5).alias("y1"), z.alias("z0"), (z + 4).alias("z1"), F.col("low").alias("y"))
    points = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 400 / 10.0 + 0.05).alias("px"), (F.col("event_id") % 370 / 10.0 + 0.02).alias("pz"))
    return finest_hits(points, fine.unionByName(coarse))
