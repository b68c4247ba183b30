"""Exact duplicates through an extendible-hash index on shared files, in DataFrame operations only.

A text's key is a 64-bit hash.  The directory has ``2 ** depth`` slots, told apart by the top bits of the key; while a bucket
holds too many distinct keys, it is split by its next bit, and the directory doubles when no slot is left to tell the halves
apart.  Slots that needn't be told apart share a bucket, so a bucket owns a range of keys.

Every row first finds its bucket in the directory.  The texts of a bucket are chained by key, told apart inside a chain by
their bytes, and each chain entry keeps its best row and its number of rows; copies are merged before the shuffle, so a text
with a third of all rows reaches its owner as one row for each task.  The entries are written, by bucket, to the shared
folder.  Rows are looked up there by bucket, key and digest; entries of very many rows are looked up by broadcast instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, hot_join, spool

#: Distinct keys of a bucket beyond which it is split.
CAPACITY = 100_000
#: Slots of the directory, and so of the broadcast: 2 ** 20 at most.  A corpus whose buckets would need more slots has
#: larger buckets instead, each still a range of keys.
MOST_DEPTH = 20
KEY_BITS = 64


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def split(counts: dict[int, int], depth: int, capacity: int = CAPACITY) -> list[int]:
    """The bucket of each slot of a directory of at most ``2 ** depth`` slots, given the keys of each prefix of that many bits.

    Starts with one slot and bucket; an overfull bucket is split by its next bit until all bits of the prefix are used.
    """
    width = 1 << depth
    before = [0] * (width + 1)
    for k in range(width):
        before[k + 1] = before[k] + counts.get(k, 0)
    cuts, deepest, full = [], 0, [(0, 0)]  # a bucket: its first bits, and how many
    while full:
        bits, local = full.pop()
        first, last = bits << depth - local, bits + 1 << depth - local
        if before[last] - before[first] > capacity and local < depth:
            full += [(2 * bits + 1, local + 1), (2 * bits, local + 1)]
        else:
            cuts.append((bits, local))
            deepest = max(deepest, local)
    slots: list[int] = []
    for number, (_, local) in enumerate(cuts):  # buckets come in the order of their keys
        slots += [number] * (1 << deepest - local)
    return slots


def slot(key: str, depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, KEY_BITS - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> list[int]:
    """The bucket of each slot for a table of distinct keys (column h).  Prefixes are counted four bits longer each time,
    until none is overfull or the directory may not grow."""
    total, depth = keys.count(), 0
    while (total >> depth) > capacity and depth < MOST_DEPTH:
        depth += 1
    while True:
        depth = min(depth + 4, MOST_DEPTH)
        counts = {r["p"]: r["n"] for r in keys.groupBy(slot("h", depth).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 ** MOST_DEPTH
        if depth == MOST_DEPTH or max(counts.values(), default=0) <= capacity:
            return split(counts, depth, capacity)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Columns doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Equal are texts whose characters besides white space are; null counts as empty.  Of equal texts the row with the most
    code points stays, then the one with the smallest id; null ids come after all others, and keep_id is null only where all
    are.  Repeated rows count each; where the staying row itself is repeated, every such row is marked as kept.  Ids may be of
    any type that has an order.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    points, text = F.coalesce(F.length(text_col), F.lit(0)), normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), points.alias("points"), text.alias("norm"))
    rows = spool(rows.withColumn("h", F.xxhash64("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256))))
    slots = directory(spool(rows.select("h").distinct()), capacity)
    table = spark.createDataFrame(list(enumerate(slots)), T.StructType().add("slot", T.LongType()).add("bucket", T.IntegerType()))
    placed = rows.withColumn("slot", slot("h", len(slots).bit_length() - 1)).join(F.broadcast(table), "slot")  # at most 2 ** MOST_DEPTH rows
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
    chains = placed.groupBy("bucket", "h", "norm").agg(best, F.count(F.lit(1)).alias("group_size"), F.any_value("sha").alias("sha"))  # bytes are compared here
    entries = chains.select("bucket", "h", "sha", (-F.col("best.points")).alias("keep_points"), F.col("best.doc_id").alias("keep_id"), "group_size")
    index = spool(entries.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "sha"))
    total = index.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    found = hot_join(placed.select("bucket", "h", "sha", "doc_id", "points"), index, ["bucket", "h", "sha"], "group_size", total)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
