"""The expand and collapse driver: which tiles a frame unloads, shows, expands, loads and hides, given what is expanded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import below, is_renderable, marked_above, visual_ancestor
from .lineage import settle


def drive(tiles: DataFrame, paths: DataFrame, expanded: DataFrame, skip: int = 3) -> DataFrame:
    """Rows (action, tile_id) for one frame; each action names a tile once.

    ``tiles`` has tile_id, parent_id, uri, in_view, in_range, loaded and hidden; ``paths`` is its flattening, ``expanded`` has
    tile_id.  In order: ``reconcile`` forgets expanded renderable tiles whose load was lost; ``collapse`` takes those out
    of view or range whose stand-in is there, and all that is expanded below them; ``unload`` their children; ``show``
    the stand-ins that weren't unloaded; ``expand`` goes up to ``skip`` levels down from what stays expanded, through
    tiles with children, in view and in range; ``load`` the children of those; ``hide`` their stand-ins, and coarser tiles above
    that aren't hidden.  Null flags are false.  No expanded tile gives no row.
    """
    flags = ["in_view", "in_range", "loaded", "hidden"]
    node = tiles.select("tile_id", "parent_id", "uri", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags])
    parents = node.where("parent_id is not null").select(F.col("parent_id").alias("tile_id")).distinct()
    node = settle(node.join(parents.withColumn("has_kids", F.lit(True)), "tile_id", "left").join(visual_ancestor(node, paths), "tile_id", "left"))
    mine = node.join(expanded.select("tile_id").distinct(), "tile_id", "left_semi")
    lost = mine.where(is_renderable() & ~F.col("loaded")).select("tile_id")
    live = settle(mine.join(lost, "tile_id", "left_anti"))
    stands = node.where("hidden").select(F.col("tile_id").alias("visual")).join(lost.select(F.col("tile_id").alias("visual")), "visual", "left_anti").withColumn("stands", F.lit(True))
    gone = live.where("not (in_view and in_range)").join(stands, "visual", "left").where(is_renderable() | F.coalesce("stands", F.lit(False))).select("tile_id", "parent_id")
    top = gone.join(gone.select(F.col("tile_id").alias("parent_id")), "parent_id", "left_anti").select("tile_id")
    level = settle(top)
    folded = []
    while not folded or not level.isEmpty():
        folded.append(level)
        level = settle(live.join(level.select(F.col("tile_id").alias("parent_id")), "parent_id", "left_semi").select("tile_id"))
    collapsed = settle(reduce(DataFrame.union, folded).distinct())
    unloaded = node.join(collapsed.select(F.col("tile_id").alias("parent_id")), "parent_id", "left_semi").select("tile_id")
    shown = node.join(collapsed, "tile_id", "left_semi").where("visual is not null").select(F.col("visual").alias("tile_id")).distinct().join(unloaded, "tile_id", "left_anti")
    stay = live.select("tile_id").join(collapsed, "tile_id", "left_anti")
    open_ = node.where("has_kids and in_view and in_range")
    level, opened = stay, []
    for _ in range(skip):
        level = open_.join(level.select(F.col("tile_id").alias("parent_id")), "parent_id", "left_semi").select("tile_id")
        opened.append(level)
    opened = settle(reduce(DataFrame.union, opened).distinct().join(stay, "tile_id", "left_anti")) if opened else stay.limit(0)
    loads = node.join(opened.select(F.col("tile_id").alias("parent_id")), "parent_id", "left_semi").where("not loaded").select("tile_id")
    again = shown.withColumn("again", F.lit(True))
    coarse = node.where(is_renderable()).join(again, "tile_id", "left").where("not hidden or again")
    above = marked_above(paths, coarse).join(opened, "tile_id", "left_semi").select(F.explode("chain").alias("tile_id"))
    hides = above.union(node.join(opened, "tile_id", "left_semi").where("visual is not null").select("visual")).distinct()
    steps = (("reconcile", lost), ("collapse", collapsed), ("unload", unloaded), ("show", shown), ("expand", opened), ("load", loads), ("hide", hides))
    return reduce(DataFrame.union, [rows.select(F.lit(name).alias("action"), "tile_id") for name, rows in steps])


def reset_failures(tiles: DataFrame, within: DataFrame, edges: DataFrame) -> DataFrame:
    """The tiles with failures, retry_at and dead cleared at and below the tiles of ``within``; ``edges`` has tile_id and parent_id."""
    cleared = below(edges, within).withColumn("_clear", F.lit(True))
    out = tiles.join(cleared, "tile_id", "left")
    clear = F.coalesce("_clear", F.lit(False))
    return out.withColumns({"failures": F.when(clear, 0).otherwise(F.col("failures")), "retry_at": F.when(~clear, F.col("retry_at")), "dead": F.when(clear, False).otherwise(F.col("dead"))}).drop("_clear")
