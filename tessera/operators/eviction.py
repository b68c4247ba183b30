"""Who goes and who comes when budgets are short: eviction in tiers, under several caps, admission by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def two_tiers(loaded: DataFrame, soft_limit: int, overshoot: float = 1.3, key: str = "session_id", distance_weight: float = 0.01) -> DataFrame:
    """Columns key, tile_id, tier for the tiles that go, where more than ``overshoot`` times the limit are loaded.

    ``loaded`` has key, tile_id, seq, selected, pinned, immune, walked, age, dist and sse.  Selected, pinned and immune tiles stay.  First
    those go that the walk didn't reach, the oldest and farthest before others; then those it reached, the finest first; as many as
    are above the limit, or all there are.  Ties in order of seq.  Null flags are false and null numbers zero.
    """
    flag = {c: F.coalesce(c, F.lit(False)) for c in ("selected", "pinned", "immune", "walked")}
    number = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("age", "dist", "sse")}
    counts = loaded.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_loaded")).where(F.col("_loaded") > soft_limit * overshoot)
    over = loaded.join(counts, F.col(key).eqNullSafe(F.col("_key"))).where(~(flag["selected"] | flag["pinned"] | flag["immune"]))
    tier = F.when(flag["walked"], 2).otherwise(1)
    score = F.when(flag["walked"], number["sse"]).otherwise(number["age"] + distance_weight * number["dist"])
    place = F.row_number().over(Window.partitionBy(key).orderBy("tier", F.desc("_score"), "seq"))
    return over.withColumns({"tier": tier, "_score": score}).withColumn("_place", place).where(F.col("_place") <= F.col("_loaded") - soft_limit).select(key, "tile_id", "tier")


def under_caps(residents: DataFrame, caps: tuple[int, int, int], key: str = "session_id") -> DataFrame:
    """Columns key, tile_id, place for the residents that go until tiles, source_bytes and gpu_bytes are all within the caps.

    ``residents`` has key, tile_id, seq, score, held, source_bytes and gpu_bytes; all count, and held ones stay.  Those of the highest score go
    first, of ties the first by seq.  Null bytes are none, a null score is the lowest.
    """
    sizes = [F.lit(1), *(F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("source_bytes", "gpu_bytes"))]
    rows = residents.withColumns({f"_s{k}": s for k, s in enumerate(sizes)}).withColumn("_held", F.coalesce("held", F.lit(False)))
    totals = rows.groupBy(F.col(key).alias("_key")).agg(*[F.sum(f"_s{k}").alias(f"_t{k}") for k in range(3)])
    exceeded = F.lit(False)
    for k, cap in enumerate(caps):
        exceeded = exceeded | (F.col(f"_t{k}") > cap)
    open_ = rows.where(~F.col("_held")).join(totals.where(exceeded), F.col(key).eqNullSafe(F.col("_key")))
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), "seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    still = F.lit(False)
    for k, cap in enumerate(caps):
        still = still | (F.col(f"_t{k}") - F.coalesce(F.col(f"_g{k}"), F.lit(0)) > cap)
    gone = open_.withColumns({f"_g{k}": F.sum(f"_s{k}").over(earlier) for k in range(3)} | {"place": F.row_number().over(order)})
    return gone.where(still).select(key, "tile_id", "place")


def first_of(rows: DataFrame, most: int, key: str, order: list[Column | str], allowed: Column | None = None) -> DataFrame:
    """The first ``most`` rows of each key that are allowed (null: not), with their ``place`` from 1."""
    kept = rows if allowed is None else rows.where(allowed)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def admitted(waiters: DataFrame, key: str, held: Column, most: int) -> DataFrame:
    """Adds ``admitted``: whether a waiter may go on, by priority and then seq, as long as what is held and what went before is below ``most``.

    ``waiters`` has key, seq, priority and n_bytes; null bytes are none.
    """
    before = F.sum(F.coalesce("n_bytes", F.lit(0))).over(Window.partitionBy(key).orderBy(F.desc_nulls_last("priority"), "seq").rowsBetween(Window.unboundedPreceding, -1))
    return waiters.withColumn("admitted", held + F.coalesce(before, F.lit(0)) < most)
