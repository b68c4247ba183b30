"""Caches of two levels: where a request is answered, what the counters say, and what the first level gives up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A cache's counters, and those that telemetry takes over, under its own names.
COUNTERS = (
    "l1Hits l2Hits misses bypasses networkFetches evictions failedWrites staleEntries revalidations revalidationHits abortedNetworkFetches bytesFromL1 bytesFromL2 bytesFromNetwork"
).split()
FORWARDED = {"l1Hits": "cacheL1Hits", "l2Hits": "cacheL2Hits", "misses": "cacheMisses", "evictions": "cacheEvictions", "failedWrites": "cacheFailedWrites"}


def probe(requests: DataFrame, memory: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``answered``: bypass where the request says so, else l1, l2 or origin, and ``found``, the stored bytes.

    ``requests`` has the keys and bypass; ``memory`` and ``store`` have each key once, with size.  A null key is never stored.
    """
    l1, l2 = (t.select(*keys, F.col("size").alias(n)) for t, n in ((memory, "_l1"), (store, "_l2")))
    both = requests.join(l1, keys, "left").join(l2, keys, "left")
    given = F.when(F.coalesce("bypass", F.lit(False)), "bypass").when(F.col("_l1").isNotNull(), "l1").when(F.col("_l2").isNotNull(), "l2").otherwise("origin")
    return both.withColumn("answered", given).withColumn("found", F.when(F.col("answered") != "bypass", F.coalesce("_l1", "_l2"))).drop("_l1", "_l2")


def hit_rates(probed: DataFrame, key: str) -> DataFrame:
    """Hits of both levels, misses, bypasses, and the rate of hits among all but bypasses; 0 where there is nothing else."""
    n = {name: F.count_if(F.col("answered") == of) for name, of in (("l1_hits", "l1"), ("l2_hits", "l2"), ("misses", "origin"), ("bypasses", "bypass"))}
    hits = n["l1_hits"] + n["l2_hits"]
    asked = hits + n["misses"]
    return probed.groupBy(key).agg(*(c.alias(name) for name, c in n.items()), F.when(asked > 0, F.round(hits / asked, 6)).otherwise(0.0).alias("hit_rate"))


def counters(events: DataFrame, key: str) -> DataFrame:
    """A row for each cache and counter, in all of COUNTERS: the sum of its amounts, 0 where no event names it, and the
    name that telemetry knows it by, if any.  Events of other names are left out."""
    spark = events.sparkSession
    names = spark.createDataFrame([(n, FORWARDED.get(n)) for n in COUNTERS], "name string, forwarded string")
    sums = events.groupBy(key, "name").agg(F.sum("amount").alias("total"))
    every = events.select(key).distinct().withColumn("name", F.explode(F.array(*map(F.lit, COUNTERS))))
    return every.join(F.broadcast(names), "name").join(sums, [key, "name"], "left").select(key, "name", "forwarded", F.coalesce("total", F.lit(0)).alias("total"))


def given_up(entries: DataFrame, cap: int | Column, key: str, order: str) -> DataFrame:
    """Adds ``evicted``: the oldest entries go until the bytes fit ``cap``; those that are unsettled or waited for stay.

    ``entries`` has size, settled and waiters; nulls of these count as 0, unsettled and none.
    """
    size, may = F.coalesce("size", F.lit(0)), F.coalesce("settled", F.lit(False)) & (F.coalesce("waiters", F.lit(0)) == 0)
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum(F.when(may, size).otherwise(0)).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("evicted", may & (F.sum(size).over(w) - before > cap))
