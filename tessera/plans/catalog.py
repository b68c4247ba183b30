"""All queries of the library, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cache_queries, frame_queries, ingest_queries, motion_queries, schedule_queries, source_queries, spatial_queries, stateful_queries, system_queries, telemetry_queries
from .registry import QUERIES, SQL

MODULES = (cache_queries, frame_queries, ingest_queries, motion_queries, schedule_queries, source_queries, spatial_queries, stateful_queries, system_queries, telemetry_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level-of-detail cut of the tile tree for one camera."""
    return spatial_queries.select_legacy(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
