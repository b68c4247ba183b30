"""Rules of a frame: what is wanted, shown, hidden later, paused, prefetched or next in line, and where a camera flies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLY_SPRINT = 4.0
SPECULATIVE = 8


def wanted(selected: DataFrame, immune: DataFrame, requested: DataFrame, keys: list[str]) -> DataFrame:
    """All nodes that a frame needs, each once."""
    return selected.select(*keys).union(immune.select(*keys)).union(requested.select(*keys)).distinct()


def visible_count(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``visible``: after each change of a session's log, how many of its tiles are shown.

    ``log`` has tile and shows (true, false; null: no change).  A tile shown twice counts once.
    """
    w = Window.partitionBy(key, "tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    was = F.coalesce(F.last("shows", True).over(w), F.lit(False))
    now = F.coalesce("shows", was)
    step = F.when(now & ~was, 1).when(~now & was, -1).otherwise(0)
    return log.withColumn("_step", step).withColumn("visible", F.sum("_step").over(Window.partitionBy(key).orderBy(*order))).drop("_step")


def hidden_later(selected: DataFrame, frames: DataFrame, after: int = 1, key: str = "session_id") -> DataFrame:
    """Rows (key, tile, dropped_at, hidden_at): tiles dropped in a frame and not selected again in it or the ``after`` frames
    that follow; 0 hides at once.  ``selected`` has key, tile and frame_no, ``frames`` the frames that there are, in a row.
    A tile is dropped in the first frame after one that selects it; nothing is hidden after a session's last frame.
    """
    last = frames.groupBy(key).agg(F.max("frame_no").alias("_last"))
    following = F.lead("frame_no").over(Window.partitionBy(key, "tile").orderBy("frame_no"))
    drops = selected.select(key, "tile", "frame_no").distinct().withColumn("again", following).withColumn("dropped_at", F.col("frame_no") + 1).withColumn("hidden_at", F.col("dropped_at") + after)
    gone = (F.col("again").isNull() | (F.col("again") > F.col("hidden_at"))) & (F.col("hidden_at") <= F.col("_last"))
    return drops.join(last, key).where(gone).select(key, "tile", "dropped_at", "hidden_at")


def unpaused(frames: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The frames in which streaming isn't locked; ``lock`` is true or false where it is set, and holds until set again."""
    w = Window.partitionBy(key).orderBy(*order)
    return frames.withColumn("_paused", F.coalesce(F.last("lock", True).over(w), F.lit(False))).where("not _paused").drop("_paused")


def speculative(frontier: DataFrame, most: int = SPECULATIVE, key: str = "session_id") -> DataFrame:
    """The pieces of a frontier that are prefetched: not loaded or ready, one level down, and the first ``most`` in order (place)."""
    asked = frontier.where("not loaded and not ready and level <= 1")
    return asked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("_n") <= most).drop("_n")


def next_job(jobs: DataFrame, admissible: Column, key: str = "session_id") -> DataFrame:
    """For each key the admissible job of highest priority, the earliest (seq) of equal ones."""
    return jobs.where(admissible).groupBy(key).agg(F.min_by("job", F.struct((-F.col("priority")).alias("p"), "seq")).alias("job"))


def live_jobs(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """Jobs that haven't been finished since they were last asked for: the latest row of each, unless ``done``."""
    latest = log.groupBy(*key).agg(F.max_by(F.struct("done", "priority"), order).alias("s"))
    return latest.where("not s.done").select(*key, "s.priority")


def refreshed(jobs: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """The jobs with the priorities of ``update`` where it names them; it never adds a job."""
    return jobs.join(update.select(*keys, F.col("priority").alias("_new")), keys, "left").withColumn("priority", F.coalesce("_new", "priority")).drop("_new")


def fly(moves: DataFrame, key: str, order: str) -> DataFrame:
    """Adds x, y and z: a flight's place after each frame.  ``moves`` has yaw (degrees), ahead, side and up (axes), sprint, speed, dt.

    Ahead and side move in the horizontal plane whatever the pitch; sprinting speeds these up, but not the climb.
    """
    a, pace = F.radians("yaw"), F.col("speed") * F.when(F.col("sprint"), FLY_SPRINT).otherwise(1.0) * F.col("dt")
    w = Window.partitionBy(key).orderBy(order)
    x = (-F.sin(a) * F.col("ahead") + F.cos(a) * F.col("side")) * pace
    z = (-F.cos(a) * F.col("ahead") - F.sin(a) * F.col("side")) * pace
    return moves.select("*", F.sum(x).over(w).alias("x"), F.sum(F.col("up") * F.col("speed") * F.col("dt")).over(w).alias("y"), F.sum(z).over(w).alias("z"))


def fades(transitions: DataFrame, frames: DataFrame, length: int, key: str = "session_id") -> DataFrame:
    """Rows (key, node, frame_no, progress, direction) of each transition (key, node, start) while it runs; in its last frame
    both sides are steady."""
    running = transitions.join(frames.select(key, "frame_no"), key).where((F.col("frame_no") >= F.col("start")) & (F.col("frame_no") <= F.col("start") + length))
    progress = F.least(F.lit(1.0), (F.col("frame_no") - F.col("start")) / F.lit(float(length)))
    both = F.array(F.struct(F.lit("parent").alias("side"), F.lit("out").alias("way")), F.struct(F.lit("children").alias("side"), F.lit("in").alias("way")))
    return running.withColumn("progress", progress).select(key, "node", "frame_no", "progress", F.explode(both).alias("s")).select(
        key, "node", "frame_no", "progress", "s.side", F.when(F.col("progress") >= 1, "steady").otherwise(F.col("s.way")).alias("direction")
    )


def collapse_ready(tiles: DataFrame, visual: DataFrame, hidden: DataFrame) -> DataFrame:
    """Rows (tile_id, ready): whether a tile's stand-in is there: itself, or a hidden one above it.  None: false."""
    found = tiles.select("tile_id").join(visual, "tile_id", "left").join(hidden.select(F.col("tile_id").alias("visual"), F.lit(True).alias("_hidden")), "visual", "left")
    return found.select("tile_id", F.coalesce((F.col("visual") == F.col("tile_id")) | F.col("_hidden"), F.lit(False)).alias("ready"))


def snapped(walkers: DataFrame, samples: DataFrame, key: str, lift: float) -> DataFrame:
    """Adds height and follows: a walker's ground with a lift and ``active`` where its sample hit, else null and ``pending``."""
    hit = walkers.join(samples.select(key, F.col("alt").alias("_alt")), key, "left")
    return hit.withColumn("height", F.col("_alt") + lift).withColumn("follows", F.when(F.col("_alt").isNotNull(), "active").otherwise("pending")).drop("_alt")
