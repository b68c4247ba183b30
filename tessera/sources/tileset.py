"""Tileset documents to a flat tree; documents that a tileset names are opened where they are named."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.lineage import settle

_NODE = "geometricError double, refine string, boundingVolume struct<box: array<double>>, content struct<uri: string, url: string>, children array<string>"


def _step(path: Column, place: Column) -> Column:
    """A path whose text sorts in pre-order: each step is its length and its digits."""
    digits = place.cast("string")
    return F.concat(path, F.lit("/"), F.length(digits).cast("string"), digits)


def read_tileset(documents: DataFrame, root_url: str, most: int = 256) -> DataFrame:
    """Rows (path, parent_path, depth, url, geometric_error, refine, box) of all nodes from the document at ``root_url``.

    ``documents`` holds (url, body), as a reader of whole texts gives.  Paths sort in pre-order.  A node that names another
    document has that document's root as its only child.  Documents that are missing, null or malformed add nothing, and a
    document inside itself isn't opened again; of repeated URLs one body is taken, the smallest.  One pass for each level of
    the tree; a tree deeper than ``most`` levels is refused.
    """
    roots = documents.where("url is not null").select("url", F.from_json("body", "root string")["root"].alias("node")).where("node is not null")
    roots = settle(roots.groupBy("url").agg(F.min("node").alias("node")))
    level = roots.where(F.col("url") == root_url).select(F.lit("0").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.col("url").alias("base"), F.array("url").alias("inside"), "node")
    found = []
    for depth in range(most + 1):
        parsed = level.withColumn("n", F.from_json("node", _NODE))
        uri = F.coalesce(F.col("n.content.uri"), F.col("n.content.url"))
        level = settle(parsed.select("path", "parent_path", F.lit(depth).alias("depth"), urls.resolve(F.col("base"), uri).alias("url"), F.col("n.geometricError").alias("geometric_error"), F.col("n.refine").alias("refine"), F.col("n.boundingVolume.box").alias("box"), F.col("n.children").alias("children"), "base", "inside"))
        if level.isEmpty():
            break
        found.append(level.drop("children", "base", "inside"))
        opens = F.col("url").contains(".json") & ~F.col("url").contains(".glb")
        own = level.where(~F.coalesce(opens, F.lit(False))).select("path", "base", "inside", F.posexplode("children").alias("place", "node"))
        own = own.select(_step(F.col("path"), F.col("place")).alias("path"), F.col("path").alias("parent_path"), "base", "inside", "node")
        named = level.where(opens & ~F.array_contains("inside", F.col("url"))).select("path", "url", "inside").join(roots, "url")
        named = named.select(_step(F.col("path"), F.lit(0)).alias("path"), F.col("path").alias("parent_path"), F.col("url").alias("base"), F.concat("inside", F.array("url")).alias("inside"), "node")
        level = own.unionByName(named)
    else:
        raise ValueError(f"deeper than {most} levels")
    return reduce(DataFrame.unionByName, found) if found else level.select("path", "parent_path", "depth", "url", "geometric_error", "refine", "box")
