"""Cache analytics: hits of a least-recently-used cache, HTTP freshness, shared fetches."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slots import walk


def lru_hits(accesses: DataFrame, cap: int, newest_stays: bool = False, parallel: int | None = None) -> DataFrame:
    """Columns cache_id, seq, key, prev, hit for accesses (cache_id, seq, key, size), whose key has one size.

    After each access the least recently used keys go until the rest fits the cap; ``prev`` is the last access of the key.
    ``newest_stays``: the key just used is never its own victim.  A null size is 0, and null keys are one key.

    Each cache is walked once in order of seq.  Its task holds the keys in the cache alone, and no pairs of accesses are made.
    """
    kinds = {f.name: f.dataType.simpleString() for f in accesses.schema.fields}
    prev = F.lag("seq").over(Window.partitionBy("cache_id", "key").orderBy("seq"))
    rows = accesses.select("cache_id", "seq", "key", F.coalesce("size", F.lit(0)).cast("long").alias("size"), prev.alias("prev"))
    least = 1 if newest_stays else 0

    def replay(own: Iterator[tuple]) -> Iterator[tuple]:
        held: OrderedDict[object, int] = OrderedDict()
        total = 0
        for seq, key, size, before in own:
            was = held.pop(key, None)
            held[key] = size
            total += size - (was or 0)
            while total > cap and len(held) > least:
                total -= held.popitem(last=False)[1]
            yield seq, key, before, was is not None

    return walk(rows, "cache_id", ["seq"], replay, f"seq {kinds['seq']}, key {kinds['key']}, prev {kinds['seq']}, hit boolean", parallel)


def freshness(cache_control: Column, age_s: Column, expires_ms: Column, now_ms: Column, most_ms: int) -> tuple[Column, Column]:
    """(cacheable, expiry) by Cache-Control, Age and Expires, capped by the policy; no expiry where not cacheable."""
    tokens = F.transform(F.split(F.lower(F.coalesce(cache_control, F.lit(""))), ","), lambda t: F.trim(t))
    age = F.try_element_at(F.filter(tokens, lambda t: t.startswith("max-age=")), F.lit(1))
    max_age = F.substring_index(age, "=", -1).try_cast("long")
    own = F.when(F.array_contains(tokens, "no-cache"), now_ms).when(max_age.isNotNull(), now_ms + F.greatest(F.lit(0), max_age - F.coalesce(age_s, F.lit(0))) * 1000).otherwise(expires_ms)
    cacheable = ~F.array_contains(tokens, "no-store")
    return cacheable, F.when(cacheable, F.least(own, now_ms + most_ms))


def coalesced(requests: DataFrame) -> DataFrame:
    """Columns event_id, key, shared, fetch for requests (event_id, key, t0, t1): a request that starts before an earlier one of its
    key ends shares its fetch; fetches of a key are numbered."""
    w = Window.partitionBy("key").orderBy("t0", "event_id")
    busy = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = requests.withColumn("shared", F.coalesce(F.col("t0") < busy, F.lit(False)))
    return r.select("event_id", "key", "shared", F.sum(F.when(F.col("shared"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("fetch"))
