"""Exact nearest-rank percentiles of groups that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """One row for each key with the smallest value that the given share of its values doesn't exceed, by name.

    Equal values are counted before any shuffle, and what is left of a key is sorted, which spills, and summed in a window: no task
    holds a key's values.  Null values are left out; a key without any has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_n").alias("_all"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).join(total, same)
    wanted = {name: F.greatest(F.lit(1), F.ceil(F.col("_all") * share)) for name, share in ranks.items()}
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= w, F.col("_v"))).alias(name) for name, w in wanted.items()])
