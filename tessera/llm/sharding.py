"""Sharding by longest-processing-time scheduling.

Groups that must stay together are sorted by size and go to the least-loaded shard, kept in a heap.  A corpus has too many
groups for one heap, but groups of one size are alike: what reaches the driver is how many groups there are of each size.
Sizes are scheduled from the largest down; of a size with many groups, all but the last few are dealt at once, by the level
that they raise the shards to, with the very outcome that one by one would have.  Groups are then numbered within their size,
and the numbers say which shard takes a group.  Distinct sizes number at most the square root of twice the corpus' bytes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gapless, hot_join, spool, utf8_bytes

#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def _deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard gets, each group going to the least-loaded shard."""
    shards, out = len(loads), [0] * len(loads)
    if count > 2 * shards:
        low, high = min(loads), max(loads) + size * (count // shards + 1)  # levels that take too few, and enough

        def taken(level: int) -> int:
            return sum(max(0, -(-(level - load) // size)) for load in loads)

        while high - low > 1:  # the highest level that all groups starting below it fit under
            middle = (low + high) // 2
            low, high = (middle, high) if taken(middle) <= count else (low, middle)
        out = [max(0, -(-(low - load) // size)) for load in loads]
    heap = [(load + size * n, s) for s, (load, n) in enumerate(zip(loads, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(out)):
        load, shard = heap[0]
        out[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return out


def schedule(sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, low, high, shard): of the groups of a size, given with their count, those numbered low to high - 1."""
    loads, runs = [0] * shards, []
    for size in sorted(sizes, reverse=True):
        at = 0
        for shard, n in enumerate(_deal(loads, size, sizes[size])):
            if n:
                runs.append((size, at, at + n, shard))
                loads[shard] += n * size
                at += n
    return runs


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Sizes of shards come out near equal (law ``bytes``); rows of equal text share a shard, even where such a group is
    larger than an even share.  A null text counts as an empty one: size 16, checksum 0, one group with the empty texts.
    Rows with null ids and repeated rows are rows like any other.  An empty table gives an empty result.  Other columns
    are ignored.  ``grown_shard`` is null, as it has a meaning for the law ``key`` only.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = spool(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (utf8_bytes(F.col(text_col)) + ROW_BYTES).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
            F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart
        )
    )
    groups = spool(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members")))
    sizes = {r["bytes"]: r["n"] for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()}
    planned = schedule(sizes, shards)
    runs = T.StructType().add("bytes", T.LongType()).add("low", T.LongType()).add("high", T.LongType()).add("shard", T.IntegerType())
    of_size = spark.createDataFrame(planned, runs).groupBy("bytes").agg(F.array_sort(F.collect_list(F.struct("high", "shard"))).alias("runs"))  # at most one for each shard
    numbered = gapless(groups, ["bytes"], ["group"], "number", max(sizes.values(), default=0)).join(of_size, "bytes")
    to = F.element_at(F.filter("runs", lambda r: r["high"] > F.col("number")), 1)
    put = spool(numbered.select("group", "members", to["shard"].alias("shard")))
    total = put.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    placed = spool(hot_join(rows, put, ["group"], "members", total).select("doc_id", "size", "text_crc32", "shard", "row"))
    most = placed.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return gapless(placed, ["shard"], ["doc_id", "text_crc32", "row"], "slot", most).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
