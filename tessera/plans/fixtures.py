"""Views over the driver's tables that stand for a tileset, camera frames, telemetry and cache accesses.

The texts are SQL that Spark and DuckDB both read; integer arithmetic decides everything but positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILES = """
SELECT CAST(0 AS BIGINT) AS tile_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS depth, CAST(0 AS BIGINT) AS ord, CAST(-180 AS DOUBLE) AS lon, CAST(-85 AS DOUBLE) AS lat
UNION ALL SELECT CAST(1 + r_regionkey AS BIGINT), CAST(0 AS BIGINT), 1, CAST(1 + r_regionkey AS BIGINT), CAST((1 + r_regionkey) * 37 % 360 - 180 AS DOUBLE), CAST((1 + r_regionkey) * 53 % 170 - 85 AS DOUBLE) FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), 2, CAST(100 + n_nationkey AS BIGINT), CAST((100 + n_nationkey) * 37 % 360 - 180 AS DOUBLE), CAST((100 + n_nationkey) * 53 % 170 - 85 AS DOUBLE) FROM nation
UNION ALL SELECT 1000 + c_custkey, CAST(100 + c_nationkey AS BIGINT), 3, 1000 + c_custkey,
  CAST((100 + c_nationkey) * 37 % 360 - 180 AS DOUBLE) + CAST((1000 + c_custkey) * 37 % 100 - 50 AS DOUBLE) / 1e2, CAST((100 + c_nationkey) * 53 % 170 - 85 AS DOUBLE) + CAST((1000 + c_custkey) * 37 % 100 - 50 AS DOUBLE) / 1e2 FROM customer
UNION ALL SELECT 1000000000 + o_orderkey, 1000 + o_custkey, 4, 1000000000 + o_orderkey,
  CAST((100 + c_nationkey) * 37 % 360 - 180 AS DOUBLE) + CAST((1000 + c_custkey) * 37 % 100 - 50 AS DOUBLE) / 1e2 + CAST((1000000000 + o_orderkey) * 37 % 100 - 50 AS DOUBLE) / 1e4,
  CAST((100 + c_nationkey) * 53 % 170 - 85 AS DOUBLE) + CAST((1000 + c_custkey) * 37 % 100 - 50 AS DOUBLE) / 1e2 + CAST((1000000000 + o_orderkey) * 37 % 100 - 50 AS DOUBLE) / 1e4
  FROM orders JOIN customer ON o_custkey = c_custkey
"""

TILE_TABLE = f"""
SELECT t.*, element_at(array_ge, depth + 1) AS ge, element_at(array_half, depth + 1) AS half,
  CASE WHEN depth = 0 THEN NULL WHEN depth = 1 THEN 'r' || tile_id || '.json' ELSE 't' || tile_id || '.glb' END AS uri,
  tile_id * 7919 % 10 < 7 AS ready
FROM ({TILES}) t CROSS JOIN (SELECT ARRAY_OF(1000000e0, 200000e0, 40000e0, 2000e0, 100e0) AS array_ge, ARRAY_OF(6400000e0, 2000000e0, 500000e0, 20000e0, 500e0) AS array_half) c
"""

#: Positions in ECEF at height 0, as X, Y, Z, and on the remapped axes as x, y, z.
PLACED = f"""
SELECT p.*, n * cos(radians(lat)) * cos(radians(lon)) AS x, n * (1 - e2) * sin(radians(lat)) AS y, -(n * cos(radians(lat)) * sin(radians(lon))) AS z
FROM (SELECT t.*, 6378137e0 / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat))) AS n FROM (SELECT u.*, 2 * (1e0 / 298.257223563e0) - (1e0 / 298.257223563e0) * (1e0 / 298.257223563e0) AS e2 FROM ({TILE_TABLE}) u) t) p
"""

FRAMES = """
SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame_no, event_id, event_type, ts,
  CAST(event_id * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(event_id * 53 % 170 - 85 AS DOUBLE) AS lat, 1000 + value * 100 AS alt, value FROM events
"""

ACCESSES = """
SELECT user_id AS cache_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, event_id, ts, value, k AS key, k * 37 % 64 + 1 AS size
FROM (SELECT user_id, ts, event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e
"""

_TABLES = ("region", "nation", "customer", "orders", "events", "part", "pages")


def duck(text: str) -> str:
    """The text in DuckDB's words."""
    return text.replace("ARRAY_OF(", "list_value(").replace("element_at(array_ge, depth + 1)", "array_ge[depth + 1]").replace("element_at(array_half, depth + 1)", "array_half[depth + 1]")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a text over the tables of sf_dir."""
    text = text.replace("ARRAY_OF(", "array(")
    for name in _TABLES:
        text = text.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`").replace(f"JOIN {name}", f"JOIN parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch as DuckDB's function of this name has them: the nearest, halves away from the epoch."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.unix_millis(F.timestamp_micros(us + F.when(us < 0, 499).otherwise(500)))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows spread over all cores by key: a table of many narrow rows may be one split, whose rows would all be made into
    files by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)
