"""Queries over URLs, binary meshes and content-addressed keys."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import glb
from .fixtures import TILE_TABLE, dealt, duck, table, view
from .registry import query

_KEY_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '([?&])(?:ref|utm_source)=[^&#]*', '\1', 'g'), '&{2,}', '&', 'g'), '\?&+', '?', 'g'), '[?&]+(#|$)', '\1', 'g')"


@query(rf"""SELECT page_id, {_KEY_SQL} AS cache_key, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, regexp_matches(url, '[?&]key=') AS has_key,
CASE WHEN regexp_matches(url, '[?&]key=') THEN url ELSE regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'key=k' || regexp_extract(url, '#.*$', 0) END AS keyed, 'pc-glb-derived-v1:sha256:' || sha256(url) AS content_key FROM pages""")
def a5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys, hosts, keyed URLs, content-addressed keys."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.cache_key(url, ("ref", "utm_source")).alias("cache_key"), urls.host(url).alias("host"), url.rlike("[?&]key=").alias("has_key"), urls.with_key(url, "k").alias("keyed"), F.concat(F.lit("pc-glb-derived-v1:sha256:"), F.sha2("url", 256)).alias("content_key"))


@query(f"SELECT tile_id, CASE WHEN uri LIKE '%.glb%' THEN 'glb' WHEN uri LIKE '%.json%' THEN 'json' WHEN uri IS NOT NULL THEN 'other' ELSE 'none' END AS kind, CAST(floor(lon * 1e5 + 0.5) AS BIGINT) || '_' || CAST(floor(lat * 1e5 + 0.5) AS BIGINT) AS keyed, CAST(floor(lon * 1e5 + 0.5) AS BIGINT) AS grid_lon, CAST(floor(lat * 1e5 + 0.5) AS BIGINT) AS grid_lat FROM ({duck(TILE_TABLE)}) t")
def d19_grid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid keys of places, and kinds of content."""
    t = view(spark, sf_dir, TILE_TABLE)
    lon, lat = (F.floor(F.col(c) * 1e5 + 0.5).cast("long") for c in ("lon", "lat"))
    return t.select("tile_id", urls.content_kind(F.col("uri")).alias("kind"), F.concat_ws("_", lon, lat).alias("keyed"), lon.alias("grid_lon"), lat.alias("grid_lat"))


def container(x: float, version: int = 2, **more: object) -> bytes:
    """A container of one triangle at x; more goes into its document."""
    body = struct.pack("<9f", x, 0, 0, x + 1, 0, 0, x, 0, 1) + struct.pack("<3H", 0, 1, 2) + b"\0\0"
    doc = {"asset": {"version": "2.0"}, "buffers": [{"byteLength": len(body)}], "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 6}],
           "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}]}
    text = json.dumps(doc | more).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<III", glb.MAGIC, version, 28 + len(text) + len(body)) + struct.pack("<II", len(text), glb.JSON_CHUNK) + text + struct.pack("<II", len(body), glb.BIN_CHUNK) + body


@query("SELECT p_partkey AS mesh_id, p_partkey % 5 <> 4 AS supported, CASE WHEN p_partkey % 5 <> 4 THEN 3 ELSE 0 END AS vertices, CASE WHEN p_partkey % 5 <> 4 THEN 1 ELSE 0 END AS triangles, CASE WHEN p_partkey % 5 <> 4 THEN CAST(p_partkey % 40 AS DOUBLE) END AS low_x, CASE WHEN p_partkey % 5 <> 4 THEN 48 ELSE 0 END AS stream_bytes FROM part")
def a17_glb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of one triangle each, a fifth of them of the wrong version."""
    make = F.udf(lambda k: bytearray(container(float(k % 40), 1 if k % 5 == 4 else 2)), "binary")  # stands for files; one cell a part
    files = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("mesh_id"), make("p_partkey").alias("content"))
    return glb.read_glb(files, "mesh_id").select("mesh_id", "supported", F.col("vertices").cast("int").alias("vertices"), F.col("triangles").cast("int").alias("triangles"), F.try_element_at("low", F.lit(1)).alias("low_x"), F.col("stream_bytes").cast("int").alias("stream_bytes"))
