"""Queries over the rules of a frame, caches of two levels, failures of a source, turned frames and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import tiles as T
from ..operators import controllers, failures, frames, hierarchy, holds, tiers
from .fixtures import ACCESSES, FRAMES, PLACED, TILE_TABLE, duck, view
from .registry import query

# Inward planes (nx, ny, nz, d) of a view of the side of positive x: near and far, and four that meet in the origin.
_PLANES = ((1.0, 0.0, 0.0, -1e6), (-1.0, 0.0, 0.0, 7e6), (0.8, 0.6, 0.0, 0.0), (0.8, -0.6, 0.0, 0.0), (0.6, 0.0, 0.8, 0.0), (0.6, 0.0, -0.8, 0.0))
_PLANES_SQL = " AND ".join(f"x * {a}e0 + y * {b}e0 + z * {c}e0 + {d:.1f}e0 >= -sqrt(3 * half * half)" for a, b, c, d in _PLANES)


@query(f"SELECT tile_id, {_PLANES_SQL} AS seen FROM ({duck(PLACED)}) t")
def c1_frustum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a plane of the view has a tile's whole bounding sphere behind it."""
    t = view(spark, sf_dir, PLACED)
    return t.select("tile_id", T.in_view(tuple(map(F.col, "xyz")), 3 * F.col("half") * F.col("half"), list(_PLANES)).alias("seen"))


_ERROR = "CASE WHEN depth = 0 THEN 0e0 ELSE ge / (1 + tile_id % 500) END"


@query(f"SELECT tile_id, NOT ready AND ({_ERROR} = 0 OR {_ERROR} <= 48) AS preload, ready AND depth >= 2 AND lon > -100 AND {_ERROR} > 0 AND {_ERROR} <= 48 AS may_hold FROM ({duck(TILE_TABLE)}) t")
def c10_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that are loaded ahead, as they aren't ready and near the wanted detail, and those that a wave may hold."""
    t = view(spark, sf_dir, TILE_TABLE)
    error = F.when(F.col("depth") == 0, 0.0).otherwise(F.col("ge") / (1 + F.col("tile_id") % 500))
    return t.select("tile_id", (~F.col("ready") & T.preloads(error)).alias("preload"), holds.may_hold(F.col("lon") > -100, F.col("ready"), error, F.col("depth") >= 2).alias("may_hold"))


_FAILS = "SELECT user_id % 7 AS source_id, event_id, event_id * 450 AS at_ms, [400, 404, 410, 422, 500][event_id % 5 + 1] AS status, CASE event_id % 6 WHEN 0 THEN 'INVALID_ARGUMENT: root' WHEN 1 THEN 'The session token is unknown' WHEN 2 THEN 'not here' END AS body FROM events WHERE event_type IN ('error', 'click')"
_COUNTS = "status IN (400, 401, 403) OR coalesce(regexp_matches(body, '(?i)invalid[_ ]argument|expired|invalid session|session token'), false)"


def _fails(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _FAILS.replace("[400, 404, 410, 422, 500][event_id % 5 + 1]", "element_at(array(400, 404, 410, 422, 500), CAST(event_id % 5 + 1 AS INT))")
    return view(spark, sf_dir, text).withColumn("counts", failures.session_failure(F.col("status"), F.col("body")))


@query(failures.refreshes().duck(f"SELECT *, {_COUNTS} AS counts FROM ({_FAILS}) f", "source_id", "at_ms"))
def g4_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session failures by status or body; five within ten seconds ask for a session, once in thirty seconds."""
    return failures.refreshes().run(_fails(spark, sf_dir), "source_id", ["at_ms"])


_ENTRIES = f"SELECT cache_id, key, max(seq) AS last, max(size) AS size FROM ({ACCESSES}) q GROUP BY cache_id, key"
_LEVELS = f"SELECT *, sum(size) OVER (PARTITION BY cache_id ORDER BY last DESC) AS upto FROM ({_ENTRIES}) m"
_ASKED = f"SELECT cache_id, seq, (key + seq) % 100 AS key, seq % 11 = 0 AS bypass FROM ({ACCESSES}) q"
_PROBED = f"SELECT a.cache_id, a.seq, a.key, a.bypass, CASE WHEN bypass THEN 'bypass' WHEN l1.size IS NOT NULL THEN 'l1' WHEN l2.size IS NOT NULL THEN 'l2' ELSE 'origin' END AS answered, CASE WHEN NOT bypass THEN coalesce(l1.size, l2.size) END AS found FROM ({_ASKED}) a LEFT JOIN (SELECT * FROM ({_LEVELS}) v WHERE upto <= 96) l1 USING (cache_id, key) LEFT JOIN (SELECT * FROM ({_LEVELS}) v WHERE upto <= 256) l2 USING (cache_id, key)"


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = view(spark, sf_dir, _LEVELS)
    return tiers.probe(view(spark, sf_dir, _ASKED), kept.where("upto <= 96"), kept.where("upto <= 256"), ["cache_id", "key"])


@query(_PROBED)
def e13_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request is answered by the memory, the store or the origin, unless it goes past the cache."""
    return _probed(spark, sf_dir)


@query(f"SELECT cache_id, count(*) FILTER (WHERE answered = 'l1') AS l1_hits, count(*) FILTER (WHERE answered = 'l2') AS l2_hits, count(*) FILTER (WHERE answered = 'origin') AS misses, count(*) FILTER (WHERE answered = 'bypass') AS bypasses, coalesce(round(count(*) FILTER (WHERE answered IN ('l1', 'l2')) / nullif(count(*) FILTER (WHERE answered <> 'bypass'), 0), 6), 0e0) AS hit_rate FROM ({_PROBED}) p GROUP BY cache_id")
def f7_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of both levels, misses, bypasses, and the hit rate without bypasses."""
    return tiers.hit_rates(_probed(spark, sf_dir), "cache_id")


_NOTES = f"SELECT cache_id, CASE answered WHEN 'l1' THEN 'l1Hits' WHEN 'l2' THEN 'l2Hits' WHEN 'bypass' THEN 'bypasses' ELSE 'misses' END AS name, CAST(1 AS BIGINT) AS amount FROM ({_PROBED}) p UNION ALL SELECT cache_id, CASE answered WHEN 'l1' THEN 'bytesFromL1' ELSE 'bytesFromL2' END, found FROM ({_PROBED}) p WHERE found IS NOT NULL"


@query(f"SELECT c.cache_id, n.name, n.forwarded, CAST(coalesce(t.total, 0) AS BIGINT) AS total FROM (SELECT DISTINCT cache_id FROM ({_NOTES}) x) c CROSS JOIN (VALUES {', '.join('({!r}, {})'.format(n, repr(tiers.FORWARDED[n]) if n in tiers.FORWARDED else 'NULL') for n in tiers.COUNTERS)}) n(name, forwarded) LEFT JOIN (SELECT cache_id, name, sum(amount) AS total FROM ({_NOTES}) x GROUP BY ALL) t ON t.cache_id = c.cache_id AND t.name = n.name")
def f18_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen counters of each cache, and the five that telemetry takes over."""
    p = _probed(spark, sf_dir)
    answers = p.select("cache_id", F.when(F.col("answered") == "l1", "l1Hits").when(F.col("answered") == "l2", "l2Hits").when(F.col("answered") == "bypass", "bypasses").otherwise("misses").alias("name"), F.lit(1).cast("long").alias("amount"))
    sizes = p.where("found is not null").select("cache_id", F.when(F.col("answered") == "l1", "bytesFromL1").otherwise("bytesFromL2").alias("name"), F.col("found").alias("amount"))
    return tiers.counters(answers.union(sizes), "cache_id")


_HELD = f"SELECT *, key % 3 <> 0 AS settled, key % 4 // 3 AS waiters FROM ({_ENTRIES}) m"


@query(f"WITH h AS (SELECT *, settled AND waiters = 0 AS may FROM ({_HELD}) x) SELECT cache_id, key, may AND sum(size) OVER (PARTITION BY cache_id) - coalesce(sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY cache_id ORDER BY last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 64 AS evicted FROM h")
def h10_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest entries that are settled and not waited for go until the rest fits."""
    m = view(spark, sf_dir, _ENTRIES)
    m = m.withColumn("settled", F.col("key") % 3 != 0).withColumn("waiters", F.floor(F.col("key") % 4 / 3).cast("int"))
    return tiers.given_up(m, 64, "cache_id", "last").select("cache_id", "key", "evicted")


_LOG = f"SELECT session_id, frame_no, event_id, event_id % 13 AS tile, event_type, value, CASE WHEN event_type IN ('view', 'click') THEN true WHEN event_type IN ('purchase', 'error') THEN false END AS shows, CASE WHEN event_type = 'error' THEN true WHEN event_type = 'signup' THEN false END AS lock FROM ({FRAMES}) q"


@query(f"WITH w AS (SELECT *, coalesce(last_value(shows IGNORE NULLS) OVER (PARTITION BY session_id, tile ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM ({_LOG}) l) SELECT session_id, frame_no, CAST(sum(CASE WHEN coalesce(shows, was) AND NOT was THEN 1 WHEN was AND NOT coalesce(shows, was) THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY frame_no) AS BIGINT) AS visible FROM w")
def f19_visible_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many tiles are shown after each change."""
    return frames.visible_count(view(spark, sf_dir, _LOG), "session_id", ["frame_no"]).select("session_id", "frame_no", "visible")


@query(f"SELECT DISTINCT session_id, tile FROM ({_LOG}) l WHERE event_type IN ('view', 'click') UNION SELECT session_id, tile FROM ({_LOG}) l WHERE event_type = 'signup'")
def i1_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is selected, immune or requested, each tile once."""
    log = view(spark, sf_dir, _LOG)
    return frames.wanted(log.where("event_type = 'view'"), log.where("event_type = 'click'"), log.where("event_type = 'signup'"), ["session_id", "tile"])


@query(f"SELECT session_id, tile, frame_no + 1 AS dropped_at, frame_no + 3 AS hidden_at FROM (SELECT session_id, tile, frame_no, lead(frame_no) OVER (PARTITION BY session_id, tile ORDER BY frame_no) AS again FROM ({_LOG}) l WHERE shows) s JOIN (SELECT session_id, max(frame_no) AS last FROM ({_LOG}) l GROUP BY session_id) m USING (session_id) WHERE (again IS NULL OR again > frame_no + 3) AND frame_no + 3 <= last")
def g10_hidden_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that are hidden two frames after they were dropped, unless selected again by then."""
    log = view(spark, sf_dir, _LOG)
    return frames.hidden_later(log.where("shows"), log, after=2)


@query(f"SELECT session_id, frame_no FROM (SELECT *, coalesce(last_value(lock IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame_no), false) AS paused FROM ({_LOG}) l) p WHERE NOT paused")
def k25_unpaused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames in which streaming isn't locked."""
    return frames.unpaused(view(spark, sf_dir, _LOG), "session_id", ["frame_no"]).select("session_id", "frame_no")


_PIECES = f"SELECT session_id, frame_no AS place, tile, CAST(event_id % 3 AS INT) AS level, event_id % 4 = 0 AS loaded, event_id % 5 = 0 AS ready FROM ({_LOG}) l"


@query(f"SELECT session_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS n FROM ({_PIECES}) p WHERE NOT loaded AND NOT ready AND level <= 1) q WHERE n <= 8")
def h15_speculative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight pieces one level down that are neither loaded nor ready."""
    return frames.speculative(view(spark, sf_dir, _PIECES)).select("session_id", "place")


_JOBS = f"SELECT session_id, tile AS job, frame_no AS seq, CAST(event_id % 17 AS DOUBLE) AS priority, event_type IN ('purchase', 'error') AS done FROM ({_LOG}) l"


@query(f"SELECT session_id, first(job ORDER BY priority DESC, seq) AS job FROM ({_JOBS}) j WHERE priority < 12 GROUP BY session_id")
def h19_next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admissible job of highest priority, the earliest of equal ones."""
    return frames.next_job(view(spark, sf_dir, _JOBS), F.col("priority") < 12)


@query(f"WITH j AS (SELECT session_id, job, arg_max(done, seq) AS done, arg_max(priority, seq) AS priority FROM ({_JOBS}) x GROUP BY ALL) SELECT session_id, job, CASE WHEN job % 5 = 1 THEN 99e0 ELSE priority END AS priority FROM j WHERE NOT done")
def k14_live_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs are removed; one node's priority is refreshed, and no job is added by it."""
    live = frames.live_jobs(view(spark, sf_dir, _JOBS), ["session_id", "job"], "seq")
    every = view(spark, sf_dir, _JOBS).select("session_id", "job").distinct()
    return frames.refreshed(live, every.where("job % 5 = 1").withColumn("priority", F.lit(99.0)), ["session_id", "job"])


_MOVES = f"SELECT session_id, frame_no, CAST(event_id * 7 % 360 AS DOUBLE) AS yaw, CAST(event_id % 3 - 1 AS DOUBLE) AS ahead, CAST(event_id % 5 % 3 - 1 AS DOUBLE) AS side, CAST(event_id % 7 % 3 - 1 AS DOUBLE) AS up, event_id % 4 = 0 AS sprint, 50e0 AS speed, 0.016e0 AS dt FROM ({FRAMES}) q"


@query(f"WITH m AS (SELECT *, radians(yaw) AS a, 50e0 * CASE WHEN sprint THEN 4 ELSE 1 END * 0.016e0 AS pace FROM ({_MOVES}) q) SELECT session_id, frame_no, round(sum((cos(a) * side - sin(a) * ahead) * pace) OVER w, 6) + 0 AS x, round(sum(up * 50e0 * 0.016e0) OVER w, 6) + 0 AS y, round(sum((-cos(a) * ahead - sin(a) * side) * pace) OVER w, 6) + 0 AS z FROM m WINDOW w AS (PARTITION BY session_id ORDER BY frame_no)")
def p33_fly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flight by axes, flat whatever the pitch, four times as fast when sprinting."""
    return frames.fly(view(spark, sf_dir, _MOVES), "session_id", "frame_no").select("session_id", "frame_no", *[(F.round(c, 6) + 0).alias(c) for c in "xyz"])


@query(f"SELECT t.session_id, t.tile AS node, f.frame_no, least(1e0, (f.frame_no - t.frame_no) / 4e0) AS progress, s.side, CASE WHEN f.frame_no - t.frame_no >= 4 THEN 'steady' ELSE s.way END AS direction FROM ({_LOG}) t JOIN ({_LOG}) f ON f.session_id = t.session_id AND f.frame_no BETWEEN t.frame_no AND t.frame_no + 4 CROSS JOIN (VALUES ('parent', 'out'), ('children', 'in')) s(side, way) WHERE t.event_type = 'purchase'")
def j10_fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transition's fades from its start until both sides are steady."""
    log = view(spark, sf_dir, _LOG)
    return frames.fades(log.where("event_type = 'purchase'").select("session_id", F.col("tile").alias("node"), F.col("frame_no").alias("start")), log, 4)


@query(f"WITH t AS ({duck(TILE_TABLE)}), a AS (SELECT t.tile_id, CASE WHEN t.depth >= 2 THEN t.tile_id END AS visual FROM t) SELECT tile_id, coalesce(visual = tile_id, false) AS ready FROM a")
def c25_collapse_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a tile could be collapsed: its nearest renderable ancestor is itself, or is hidden."""
    t = view(spark, sf_dir, TILE_TABLE)
    return frames.collapse_ready(t, hierarchy.visual_ancestor(t, hierarchy.flatten(t)), t.where("tile_id % 3 = 0"))


@query(f"SELECT session_id, frame_no, CASE WHEN event_id % 3 <> 0 THEN value + 1.5e0 END AS height, CASE WHEN event_id % 3 <> 0 THEN 'active' ELSE 'pending' END AS follows, count(*) FILTER (WHERE event_id % 3 = 0) OVER (PARTITION BY session_id) AS pending FROM ({_LOG}) l")
def p38_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walkers on the ground of their sample, with a lift, or pending; and how many are pending."""
    log = view(spark, sf_dir, _LOG)
    on = frames.snapped(log, log.where("event_id % 3 <> 0").select("event_id", F.col("value").alias("alt")), "event_id", 1.5).select("session_id", "frame_no", "height", "follows")
    return on.join(on.groupBy("session_id").agg(F.count_if(F.col("follows") == "pending").alias("pending")), "session_id")


_SCALE = "greatest(0.35e0, 1 - tile_id % 14 * 0.05e0)"


@query(f"SELECT tile_id, CAST(greatest(32, floor({_SCALE} * 500)) AS BIGINT) AS tiles, CAST(greatest(67108864, floor({_SCALE} * 100000000)) AS BIGINT) AS source_bytes, CAST(greatest(268435456, floor({_SCALE} * 700000000)) AS BIGINT) AS gpu_bytes FROM ({duck(TILE_TABLE)}) t")
def g16_resident_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps on what stays resident at a scale, with their floors."""
    scale = F.greatest(F.lit(0.35), 1 - F.col("tile_id") % 14 * 0.05)
    return view(spark, sf_dir, TILE_TABLE).select("tile_id", *controllers.resident_limits(scale, 500, 100_000_000, 700_000_000))


_TURNED = G.LocalFrame.at(21.7346, 38.2466, 120.0, yaw=30.0, pitch=-12.0, roll=5.0)


def _turned_sql() -> str:
    """The turned frame worked out by rotation matrices in SQL."""
    rot = "SELECT radians(30e0) AS yw, radians(-12e0) AS pt, radians(5e0) AS rl, radians(21.7346e0) AS la, radians(38.2466e0) AS ph, 6378137e0 AS a_, 2 / 298.257223563e0 - 1 / (298.257223563e0 * 298.257223563e0) AS e2"
    dirs = "SELECT *, -sin(la) * e - sin(ph) * cos(la) * n + cos(ph) * cos(la) * u AS vx, cos(ph) * n + sin(ph) * u AS vy, -cos(la) * e + sin(ph) * sin(la) * n - cos(ph) * sin(la) * u AS vz FROM q, r"
    # back through the basis to (east, up, south), then undo yaw, pitch and roll one by one
    back = "SELECT *, -sin(la) * vx - cos(la) * vz AS b0, cos(ph) * cos(la) * vx + sin(ph) * vy - cos(ph) * sin(la) * vz AS b1, sin(ph) * cos(la) * vx - cos(ph) * vy - sin(ph) * sin(la) * vz AS b2 FROM d"
    yaw = "SELECT *, cos(yw) * b0 - sin(yw) * b2 AS y0, b1 AS y1, sin(yw) * b0 + cos(yw) * b2 AS y2 FROM b"
    pitch = "SELECT *, y0 AS p0, cos(pt) * y1 + sin(pt) * y2 AS p1, -sin(pt) * y1 + cos(pt) * y2 AS p2 FROM y"
    roll = "SELECT *, cos(rl) * p0 + sin(rl) * p1 AS l0, -sin(rl) * p0 + cos(rl) * p1 AS l1, p2 AS l2 FROM p"
    source = f"SELECT tile_id, CAST(tile_id % 11 - 5 AS DOUBLE) AS e, CAST(tile_id % 7 - 3 AS DOUBLE) AS n, CAST(tile_id % 5 - 2 AS DOUBLE) AS u FROM ({duck(TILE_TABLE)}) t"
    return f"WITH r AS ({rot}), q AS ({source}), d AS ({dirs}), b AS ({back}), y AS ({yaw}), p AS ({pitch}), l AS ({roll}) SELECT tile_id, round(l0, 9) + 0 AS x, round(l1, 9) + 0 AS y, round(l2, 9) + 0 AS z FROM l"


@query(_turned_sql())
def b9_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions by east, north and up on the axes of a frame turned by yaw, pitch and roll."""
    e, n, u = (F.col("tile_id") % m - k for m, k in ((11, 5), (7, 3), (5, 2)))
    local = _TURNED.direction_to_local(*(c.cast("double") for c in (e, n, u)))
    return view(spark, sf_dir, TILE_TABLE).select("tile_id", *[(F.round(c, 9) + 0).alias(k) for k, c in zip("xyz", local)])


# A turn about y of the angle whose cosine is 0.6, a scale of 2 and a shift, column-major.
_MATRIX = [1.2, 0.0, -1.6, 0.0, 0.0, 2.0, 0.0, 0.0, 1.6, 0.0, 1.2, 0.0, 10.0, 20.0, 30.0, 1.0]


@query(f"SELECT tile_id, 1.2e0 * lon + 1.6e0 * half + 10 AS x, 2 * lat + 20 AS y, -1.6e0 * lon + 1.2e0 * half + 30 AS z FROM ({duck(TILE_TABLE)}) t")
def p19_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a node that is placed by a column-major matrix."""
    moved = G.affine(_MATRIX, (F.col("lon"), F.col("lat"), F.col("half")))
    return view(spark, sf_dir, TILE_TABLE).select("tile_id", *[c.alias(k) for k, c in zip("xyz", moved)])
