"""Queries over tileset documents, polygons, materials and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import LocalFrame
from ..operators import sessions
from ..sources import geojson, gltf, tileset
from .fixtures import dealt, table, view
from .ingest_queries import container
from .registry import query

_BASE = "https://tiles.test/v1/"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tileset of regions, each a document of its own with its nations."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")

    def node(error: float, uri, *more):  # type: ignore[no-untyped-def]
        return F.struct(F.lit(error).alias("geometricError"), F.struct(uri.alias("uri")).alias("content"), *more)

    kids = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(node(100.0, F.format_string("n%02d.glb", "n_nationkey")))).alias("children"))
    inner = region.join(kids, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    inner = inner.select(F.format_string(_BASE + "r/%d.json", "r_regionkey").alias("url"), F.to_json(F.struct(node(400.0, F.format_string("../glb/r%d.glb", "r_regionkey"), F.col("children")).alias("root"))).alias("body"))
    top = region.agg(F.sort_array(F.collect_list(node(500.0, F.format_string("./r/%d.json?session=s%d", "r_regionkey", "r_regionkey")))).alias("children"))
    top = top.select(F.lit(_BASE + "tileset.json").alias("url"), F.to_json(F.struct(F.struct(F.lit(1000.0).alias("geometricError"), "children").alias("root"))).alias("body"))
    return top.union(inner.withColumn("url", F.concat("url", F.lit("?session=s"), F.regexp_extract("url", r"(\d+)\.json", 1))))


_URL = f"'{_BASE}r/' || r_regionkey || '.json?session=s' || r_regionkey"


@query(f"""SELECT 0 AS depth, CAST(NULL AS VARCHAR) AS url, 1000e0 AS geometric_error, CAST(NULL AS VARCHAR) AS parent_url
UNION ALL SELECT 1, {_URL}, 500e0, NULL FROM region UNION ALL SELECT 2, '{_BASE}glb/r' || r_regionkey || '.glb', 400e0, {_URL} FROM region
UNION ALL SELECT 3, '{_BASE}r/n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.glb', 100e0, '{_BASE}glb/r' || n_regionkey || '.glb' FROM nation""")
def a10_tileset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tileset documents flattened, named documents opened, URIs resolved."""
    tree = tileset.read_tileset(_documents(spark, sf_dir), _BASE + "tileset.json")
    up = tree.select(F.col("path").alias("parent_path"), F.col("url").alias("parent_url"))
    return tree.join(up, "parent_path", "left").select("depth", "url", "geometric_error", "parent_url")


@query("SELECT 's' || min(r_regionkey) AS session FROM region")
def a16_first_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first token of a tree in pre-order."""
    return sessions.first_in_tree(tileset.read_tileset(_documents(spark, sf_dir), _BASE + "tileset.json"))


_REQUESTS = """SELECT user_id AS source_id, event_id AS seq, 'https://tiles.test/t' || event_id || '.glb' || CASE WHEN event_id % 3 = 0 THEN '?session=u' || event_id || '&key=k' WHEN event_id % 3 = 1 THEN '?key=k' ELSE '' END AS url,
  CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE 'g' || event_id END END AS given, event_id % 29 = 0 AS root FROM events"""


@query(f"""WITH h AS (SELECT *, coalesce(last_value(CASE WHEN given <> '' THEN given END IGNORE NULLS) OVER w, first_value(CASE WHEN seq % 3 = 0 AND NOT root THEN 'u' || seq END IGNORE NULLS) OVER w) AS held FROM ({_REQUESTS}) r
  WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), b AS (SELECT *, 'https://tiles.test/t' || seq || '.glb' AS plain FROM h)
SELECT source_id, seq, CASE WHEN NOT root THEN held END AS session, plain || CASE WHEN root THEN CASE WHEN seq % 3 < 2 THEN '?key=k' ELSE '' END
  WHEN seq % 3 = 0 THEN '?session=' || held || '&key=k' WHEN seq % 3 = 1 THEN '?key=k' || coalesce('&session=' || held, '') ELSE coalesce('?session=' || held, '') END AS request_url,
  CASE WHEN NOT root THEN plain END AS cache_key, NOT root AS cacheable, CASE WHEN NOT root THEN 10800000 END AS max_age_ms FROM b""")
def a7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token that each request carries, its URL and how long it may be kept."""
    return sessions.requests(view(spark, sf_dir, _REQUESTS))


_SHAPES = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"type":"Polygon","coordinates":[' || ring || ']}' WHEN 1 THEN '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[' || ring || ']]}}'
  WHEN 2 THEN '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","geometry":{"type":"Polygon","coordinates":[' || ring || ']}}]}'
  WHEN 3 THEN '{"type":"Polygon","coordinates":[[[1,2],[3,4]]]}' ELSE 'no json' END AS body
FROM (SELECT event_id, '[[' || lon || ',38],[' || (lon + 1) || ',38],[' || (lon + 1) || ',39],[' || lon || ',38]]' AS ring FROM (SELECT event_id, event_id % 90 AS lon FROM events) e) s"""


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 3 END AS vertices, CASE WHEN event_id % 5 < 3 THEN CAST(event_id % 90 AS DOUBLE) END AS first_lon, CASE WHEN event_id % 5 < 3 THEN event_id % 90 = 21 END AS at_origin FROM events")
def a25_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first polygon of GeoJSON, opened, cut to its most vertices and projected."""
    ring = geojson.corners(geojson.first_ring(F.col("body")))
    made = view(spark, sf_dir, _SHAPES).select("event_id", ring.alias("ring"))
    p = F.get(geojson.project(F.col("ring"), LocalFrame.at(21.0, 38.0)), F.lit(0))
    near = (F.abs(p["x"]) < 1e-3) & (F.abs(p["z"]) < 1e-3)
    return made.select("event_id", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("vertices"), F.get(F.get("ring", F.lit(0)), F.lit(0)).alias("first_lon"), near.alias("at_origin"))


def _textured(k: int) -> bytes:
    """A container with a material; every third names what it has, the others leave it to defaults."""
    full = {"name": f"m{k}", "pbrMetallicRoughness": {"baseColorFactor": [0.5, 0.25, 0, 1], "baseColorTexture": {"index": k % 7}}, "doubleSided": True, "alphaMode": "MASK", "alphaCutoff": 0.25, "extensions": {"KHR_materials_unlit": {}}}
    more = {"images": [{"bufferView": 1, "mimeType": "image/jpeg", "name": f"i{k}"}], "nodes": [{"mesh": 0, "translation": [k, 2, 3]}], "scenes": [{"nodes": [0]}], "textures": [{"source": 0}]}
    return container(1.0, 1 if k % 10 == 9 else 2, materials=[full if k % 3 == 0 else {}], samplers=[{"magFilter": 9728}] if k % 2 else [{}], **more)


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = F.udf(lambda k: bytearray(_textured(k)), "binary")  # stands for files
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("mesh_id"), make("p_partkey").alias("content"))


@query("""SELECT p_partkey AS mesh_id, p_partkey % 10 <> 9 AS supported, CASE WHEN ok THEN CASE WHEN p_partkey % 3 = 0 THEN 'm' || p_partkey ELSE '' END END AS material, CASE WHEN ok THEN CASE WHEN p_partkey % 3 = 0 THEN 0.25e0 ELSE 1e0 END END AS green,
  CASE WHEN ok AND p_partkey % 3 = 0 THEN CAST(p_partkey % 7 AS INTEGER) END AS texture, CASE WHEN ok THEN p_partkey % 3 = 0 END AS double_sided, CASE WHEN ok THEN CASE WHEN p_partkey % 3 = 0 THEN 'MASK' ELSE 'OPAQUE' END END AS alpha_mode,
  CASE WHEN ok THEN CASE WHEN p_partkey % 3 = 0 THEN 0.25e0 ELSE 0.5e0 END END AS alpha_cutoff, CASE WHEN ok THEN p_partkey % 3 = 0 END AS unlit, CASE WHEN ok THEN CASE WHEN p_partkey % 2 = 1 THEN 9728 ELSE 9729 END END AS mag_filter,
  CASE WHEN ok THEN 10497 END AS wrap, CASE WHEN ok THEN CAST(p_partkey AS DOUBLE) END AS moved_x FROM (SELECT *, p_partkey % 10 <> 9 AS ok FROM part)""")
def a21_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials, samplers, nodes with defaults."""
    p = gltf.project(gltf.documents(_containers(spark, sf_dir), "mesh_id"))
    m, s, n = (F.get(c, F.lit(0)) for c in ("materials", "samplers", "nodes"))
    return p.select(
        "mesh_id", "supported", m["name"].alias("material"), F.get(m["factor"], F.lit(1)).alias("green"), m["texture"].alias("texture"), m["double_sided"].alias("double_sided"), m["alpha_mode"].alias("alpha_mode"),
        m["alpha_cutoff"].alias("alpha_cutoff"), m["unlit"].alias("unlit"), s["magFilter"].alias("mag_filter"), s["wrapS"].alias("wrap"), F.get(n["translation"], F.lit(0)).alias("moved_x"),
    )


@query("SELECT p_partkey AS mesh_id, 0 AS image, 'i' || p_partkey AS name, 'image/jpeg' AS mime, 6 AS n_bytes FROM part WHERE p_partkey % 10 <> 9")
def a20_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images inside containers."""
    return gltf.images(_containers(spark, sf_dir), "mesh_id").select("mesh_id", "image", "name", "mime", F.length("bytes").alias("n_bytes"))
