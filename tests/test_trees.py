"""Walks down trees: results on odd trees, and no join that gives the tiles of a tree to the task of its root."""

import re

from tessera.operators import hierarchy, legacy, states
from tessera.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TILES = "tile_id long, parent_id long"


def joined_on_above(df):
    """Whether the plan has a join on the ancestor of rows that stand for a tile and an ancestor."""
    return bool(re.search(r"Join.*above", df._jdf.queryExecution().optimizedPlan().toString()))


def test_below_on_trees_and_cycles(spark):
    # 1 has 2 and 3, 2 has 4; 10 and 11 are a cycle under no root; 20's parent is not there; 5 stands twice.
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (5, 4), (10, 11), (11, 10), (12, 12), (20, 19)], TILES)

    def under(*tops):
        return sorted(r.tile_id for r in hierarchy.below(edges, spark.createDataFrame([(t,) for t in tops], "tile_id long")).collect())

    assert under(2) == [2, 4, 5] and under(1, 2, 4, 4) == [1, 2, 3, 4, 5] and under(10, 12) == [10, 11, 12]
    assert under(None) == under() == [] and under(19) == [19, 20]


def test_failures_are_reset_without_rows_of_ancestors(spark):
    tiles = spark.createDataFrame([(1, None, 1, 9, True), (2, 1, 2, 9, True), (3, 2, 3, 9, True), (7, 6, 4, 9, True)], f"{TILES}, failures int, retry_at long, dead boolean")
    got = legacy.reset_failures(tiles, spark.createDataFrame([(2,), (6,)], "tile_id long"), hierarchy.flatten(tiles))
    assert not joined_on_above(got) and {(r.tile_id, r.failures) for r in got.collect()} == {(1, 1), (2, 0), (3, 0), (7, 4)}
    got = legacy.reset_failures(tiles, spark.createDataFrame([(2,), (6,)], "tile_id long"), tiles)
    assert {(r.tile_id, r.failures) for r in got.collect()} == {(1, 1), (2, 0), (3, 0), (7, 0)}


def test_enabled_throughout(spark):
    # 2 is off and so is all under it, 3 has no flag, 5 is not visible but lets 6 be; 9 has no root.
    rows = [(1, None, True, True), (2, 1, True, False), (3, 1, True, None), (4, 2, True, True), (5, 1, None, True), (6, 5, True, True), (7, 4, True, True), (8, None, True, True), (9, 99, True, True)]
    got = states.enabled_throughout(spark.createDataFrame(rows, f"{TILES}, visible boolean, enabled boolean"))
    assert {(r.tile_id, r.alive) for r in got.collect()} == {(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (7, False), (8, True)}
    assert states.enabled_throughout(spark.createDataFrame([], f"{TILES}, visible boolean, enabled boolean")).count() == 0


def test_enabled_tiles_are_found_without_rows_of_ancestors(spark):
    assert not joined_on_above(catalog.queries()["c16_enabled"](spark, SF_DIR))


def test_marked_tiles_above(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (8, None)], TILES)
    marked = spark.createDataFrame([(1,), (3,), (3,), (4,), (None,)], "tile_id long")
    got = hierarchy.marked_above(hierarchy.flatten(edges), marked).collect()
    assert {r.tile_id: r.chain for r in got} == {1: [1], 2: [1], 3: [1, 3], 4: [1, 3, 4], 8: []}


def test_ancestors_are_found_without_rows_of_ancestors(spark):
    for name in ("e3_visual_ancestor", "e4_coarser_ancestors", "c25_collapse_ready"):
        assert not joined_on_above(catalog.queries()[name](spark, SF_DIR))
