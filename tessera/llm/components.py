"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool


def components(edges: DataFrame, left: str = "u", right: str = "v", most: int = 60) -> DataFrame:
    """Columns node and root (the smallest node reachable) for every node that has an edge.

    Nodes are longs; edges go either way, may repeat, and those to oneself or with a null end are left out.  Each round
    is spooled to the shared folder, so the plan stays short.  The number of rounds grows with the logarithm of the
    longest path; ``most`` guards against a fault and raises.
    """
    now = spool(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    seen = _mark(now)
    for _ in range(most):
        if seen[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(first.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = spool(small)
        was, seen = seen, _mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(members.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return n, int(total)
