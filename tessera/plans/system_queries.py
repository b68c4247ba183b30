"""Queries over providers, readiness, changes between frames, scene graphs and read-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers
from ..operators import legacy, quantiles, states
from .fixtures import FRAMES, TILE_TABLE, duck, table, view
from .registry import query

_BODIES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"url":"https://a.test/t' || event_id || '","accessToken":"k' || event_id || '"}' WHEN 1 THEN '{"url":"https://a.test/t.json"}'
  WHEN 2 THEN '{"externalType":"3DTILES","options":{"url":"https://tile.googleapis.com/v1/3dtiles/root.json?key=' || event_id || '"}}' WHEN 3 THEN '{"externalType":"3DTILES","options":{"url":"https://b.test/3dtiles/root.json"}}'
  WHEN 4 THEN '{"externalType":"IMAGERY","options":{"url":"https://c.test"}}' ELSE 'no json' END AS body FROM events"""


@query("""SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'session' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'unsupported' ELSE 'direct' END AS kind, CASE event_id % 6 WHEN 0 THEN 'https://a.test/t' || event_id WHEN 1 THEN 'https://a.test/t.json' WHEN 2 THEN 'https://tile.googleapis.com/v1/3dtiles/root.json?key=' || event_id
  WHEN 3 THEN 'https://b.test/3dtiles/root.json' END AS url, CASE WHEN event_id % 6 = 0 THEN 'Bearer k' || event_id END AS header FROM events""")
def a8_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each endpoint document leads to."""
    kind, url, header = providers.endpoint(F.col("body"))
    return view(spark, sf_dir, _BODIES).select("event_id", kind.alias("kind"), url.alias("url"), header.alias("header"))


_CONFIGS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'cesium-ion' WHEN 2 THEN 'url' END AS p1, CASE WHEN event_id % 3 > 0 THEN 'k' || event_id ELSE '' END AS c1, CASE WHEN event_id % 5 > 0 THEN '7' END AS a1, CASE WHEN event_id % 7 > 0 THEN 'u' END AS u1,
  CASE WHEN event_id % 2 = 0 THEN 'google' ELSE 'url' END AS p2, CASE WHEN event_id % 11 > 0 THEN 's' END AS c2 FROM events"""
_LACKS = "CASE WHEN {p} = 'google' AND coalesce({c}, '') = '' THEN 'key required' WHEN {p} = 'cesium-ion' AND (coalesce({c}, '') = '' OR coalesce({a}, '') = '') THEN 'token and asset required' WHEN {p} = 'url' AND coalesce({u}, '') = '' THEN 'url required' END"


@query(f"""WITH m AS (SELECT *, {_LACKS.format(p='p1', c='c1', a='a1', u='u1')} AS missing, {_LACKS.format(p='p2', c='c2', a='NULL', u='NULL')} AS missing2 FROM ({_CONFIGS}) q)
SELECT event_id, missing, CASE WHEN p1 IS NOT NULL AND missing IS NULL THEN p1 WHEN missing2 IS NULL THEN p2 END AS provider, CASE WHEN p1 IS NOT NULL AND missing IS NULL THEN c1 WHEN missing2 IS NULL THEN c2 END AS credential FROM m""")
def a30_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a configuration lacks, and the first whole one."""
    first = (F.col("p1"), F.col("c1"), F.col("a1"), F.col("u1"))
    none = F.lit(None).cast("string")
    used = providers.preferred(first, (F.col("p2"), F.col("c2"), none, none))
    return view(spark, sf_dir, _CONFIGS).select("event_id", providers.missing(*first).alias("missing"), used["provider"].alias("provider"), used["credential"].alias("credential"))


_FLAGS = f"SELECT tile_id, parent_id, depth, uri, CASE tile_id % 6 WHEN 0 THEN 'decoding' WHEN 1 THEN 'visible' WHEN 2 THEN 'resident' WHEN 3 THEN 'renderReady' END AS stage, tile_id % 5 < 3 AS entity, tile_id % 7 = 0 AS resident, tile_id % 4 = 0 AS dead, CASE WHEN tile_id % 8 = 0 THEN tile_id % 900 END AS dead_until, tile_id % 800 AS next_at, tile_id = 0 OR tile_id % 13 > 0 AS enabled, tile_id % 3 > 0 AS visible FROM ({TILE_TABLE}) t"


@query(f"""SELECT tile_id, coalesce(uri LIKE '%.glb%', false) AND (stage IS NULL OR stage <> 'decoding') AND (entity OR resident) AS shows, NOT (dead AND (coalesce(dead_until, 0) = 0 OR 500 < dead_until)) AND next_at <= 500 AS due, dead AND (coalesce(dead_until, 0) = 0 OR 500 < dead_until) AS still_dead,
  (tile_id % 3 = 0 OR tile_id % 40 < tile_id % 3 * 16) AND tile_id % 300 < 256 AND tile_id % 600 < 512 AS room FROM ({duck(_FLAGS)}) f""")
def c7_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that can be shown, loads that may be tried again, room for more."""
    due, dead = states.retry_due(F.col("dead"), F.col("dead_until"), F.col("next_at"), F.lit(500))
    k = F.col("tile_id")
    room = states.has_room(k % 40, k % 3 * 16, k % 300 * (1 << 20), k % 600 * (1 << 20))
    return view(spark, sf_dir, _FLAGS).select("tile_id", states.shows_now(F.col("uri"), F.col("stage"), F.col("entity"), F.col("resident")).alias("shows"), due.alias("due"), dead.alias("still_dead"), room.alias("room"))


@query(f"""WITH RECURSIVE t AS MATERIALIZED ({duck(_FLAGS)}), w AS (SELECT tile_id, enabled AS on_ FROM t WHERE parent_id IS NULL UNION ALL SELECT t.tile_id, t.enabled AND on_ FROM t JOIN w ON t.parent_id = w.tile_id) SELECT tile_id, visible AND on_ AS alive FROM w JOIN t USING (tile_id)""")
def c16_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that are seen because they and all above them are enabled."""
    return states.enabled_throughout(view(spark, sf_dir, _FLAGS))


@query(f"""SELECT coalesce(a.tile_id, b.tile_id) AS tile_id, CASE WHEN b.tile_id IS NULL THEN 'clear' ELSE 'set' END AS change, depth FROM (SELECT tile_id FROM ({duck(TILE_TABLE)}) t WHERE tile_id % 3 = 0) a
FULL JOIN (SELECT tile_id, depth FROM ({duck(TILE_TABLE)}) t WHERE tile_id % 2 = 0) b ON a.tile_id = b.tile_id WHERE a.tile_id IS NULL OR b.tile_id IS NULL""")
def i4_stencils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stencils that a selection sets and clears."""
    t = view(spark, sf_dir, TILE_TABLE)
    return states.stencils(t.where("tile_id % 3 = 0"), t.where("tile_id % 2 = 0"))


_STAGES = f"SELECT session_id, frame_no, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'decoding' WHEN 2 THEN 'renderReady' WHEN 3 THEN 'renderReady' WHEN 4 THEN 'resident' WHEN 5 THEN 'resident' ELSE 'visible' END AS stage FROM ({FRAMES}) f"
_HELD = "('renderReady', 'visible', 'resident')"


@query(f"""WITH s AS (SELECT *, lag(stage) OVER (PARTITION BY session_id ORDER BY frame_no) AS was FROM ({_STAGES}) q), c AS (SELECT session_id, frame_no, CASE WHEN stage IS NULL THEN CASE WHEN was IN {_HELD} THEN 'unload' END WHEN stage = 'decoding' THEN NULL
  WHEN was IS NULL OR was = 'decoding' THEN 'load' WHEN was || '>' || stage = 'resident>visible' THEN 'restore' WHEN was || '>' || stage = 'renderReady>visible' THEN 'show' WHEN was || '>' || stage = 'visible>resident' THEN 'hide' END AS type FROM s) SELECT * FROM c WHERE type IS NOT NULL""")
def s3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of changes that a log of stages tells."""
    return states.changes(view(spark, sf_dir, _STAGES), ["session_id"], "frame_no")


@query("""WITH n AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS node FROM nation) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(node AS BIGINT) AS node FROM n WHERE CASE WHEN doc_id % 2 = 0 THEN node = 3 ELSE node IN (0, 3) END""")
def e12_scene_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots of scene graphs, by their scenes or by what nobody names."""
    ranked = view(spark, sf_dir, "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS node FROM nation")
    kids = F.when(F.col("node") == 0, F.array(F.lit(1), F.lit(2))).when(F.col("node") == 3, F.array(F.lit(4), F.lit(99))).cast("array<bigint>")
    docs = ranked.select("doc_id").distinct()
    return states.scene_roots(ranked.withColumn("children", kids), docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(3), F.lit(77))).cast("array<bigint>").alias("nodes")))


@query("""SELECT event_type || ' ' || count(*) || ' mean ' || CAST(floor(avg(value)) AS BIGINT) || ' p95 ' || CAST(floor(quantile_disc(value, 0.95)) AS BIGINT) AS line FROM events WHERE value >= 0 GROUP BY event_type""")
def s5_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text for each metric."""
    good = table(spark, sf_dir, "events").where("value >= 0")
    found = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("value")).alias("mean"))
    found = found.join(quantiles.nearest_rank(good, ["event_type"], "value", {"p95": 0.95}), "event_type").withColumn("p95", F.floor("p95"))
    return found.select(F.format_string("%s %d mean %d p95 %d", "event_type", "n", "mean", "p95").alias("line"))


_ZONES = "SELECT user_id AS session_id, event_id AS seq, event_id * 7 % 23 AS zone_id, CASE WHEN event_id % 3 = 0 THEN 'polygon' ELSE 'circle' END AS kind, CASE event_id % 5 WHEN 0 THEN 'remove' WHEN 1 THEN NULL ELSE 'add' END AS event FROM events"


@query(f"""WITH z AS ({_ZONES}), a AS (SELECT session_id, zone_id, kind, min(seq) AS first FROM z WHERE event = 'add' AND seq > coalesce((SELECT max(g.seq) FROM z g WHERE g.event = 'remove' AND g.session_id = z.session_id AND g.zone_id = z.zone_id), -1) GROUP BY ALL)
SELECT session_id, zone_id, kind, CAST(row_number() OVER (PARTITION BY session_id, kind ORDER BY first) AS INTEGER) AS place, row_number() OVER (PARTITION BY session_id, kind ORDER BY first) <= 4 AS bound FROM a""")
def k23_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that are there after a log of additions and removals, and the first that are bound."""
    return states.live_zones(view(spark, sf_dir, _ZONES), 4)


_FAILED = f"SELECT tile_id, parent_id, CAST(tile_id % 4 AS INTEGER) AS failures, CASE WHEN tile_id % 4 > 0 THEN tile_id % 900 END AS retry_at, tile_id % 8 = 3 AS dead FROM ({TILE_TABLE}) t"


@query(f"""WITH RECURSIVE t AS MATERIALIZED ({duck(_FAILED)}), w AS (SELECT tile_id FROM t WHERE tile_id IN (2, 103, 1007) UNION SELECT t.tile_id FROM t JOIN w ON t.parent_id = w.tile_id)
SELECT t.tile_id, CASE WHEN w.tile_id IS NULL THEN failures ELSE 0 END AS failures, CASE WHEN w.tile_id IS NULL THEN retry_at END AS retry_at, dead AND w.tile_id IS NULL AS dead FROM t LEFT JOIN w USING (tile_id)""")
def j15_reset_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures forgotten at and below some tiles."""
    t = view(spark, sf_dir, _FAILED)
    within = spark.createDataFrame([(2,), (103,), (1007,)], "tile_id long")
    return legacy.reset_failures(t, within, t).select("tile_id", "failures", "retry_at", "dead")


@query(f"WITH t AS ({duck(TILE_TABLE)}) SELECT tile_id, CASE WHEN tile_id % 3 = 0 THEN 'a' ELSE 'r' END || tile_id AS entity, tile_id % 3 <> 0 AS resident FROM t WHERE tile_id % 3 = 0 OR tile_id % 4 = 0")
def p14_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of each tile, active before kept."""
    t = view(spark, sf_dir, TILE_TABLE)
    return states.entities(t.where("tile_id % 3 = 0").selectExpr("tile_id", "'a' || tile_id AS entity"), t.where("tile_id % 4 = 0").selectExpr("tile_id", "'r' || tile_id AS entity"))


@query("""SELECT p_partkey AS doc_id, p_partkey % 4 AS texture, CASE WHEN p_partkey % 3 < 2 THEN 'i' || (p_partkey % 3) END AS image, CASE WHEN p_partkey % 5 = 0 THEN 9728 END AS sampler FROM part""")
def e11_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textures with the images and samplers that they name."""
    k = F.col("p_partkey")
    one = F.struct(F.when(k % 3 < 2, k % 3).otherwise(9).cast("int").alias("source"), F.when(k % 5 == 0, 0).alias("sampler"))
    found = states.textures(F.array(one), F.array(F.lit("i0"), F.lit("i1")), F.array(F.lit(9728)))
    t = F.get(found, F.lit(0))
    return table(spark, sf_dir, "part").select(k.alias("doc_id"), (k % 4).alias("texture"), t["image"].alias("image"), t["sampler"].alias("sampler"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'HTTP ' || (400 + page_id % 100) || ': ' || left(html, 400) END AS error FROM pages")
def p24_http_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed responses in words: the status and the first 400 characters of the body."""
    failed = F.concat(F.lit("HTTP "), (400 + F.col("page_id") % 100).cast("string"), F.lit(": "), F.substring("html", 1, 400))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, failed).alias("error"))
