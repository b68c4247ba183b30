"""Small trees, frames and containers with results worked out by hand."""

import math
import random

import pytest

from tessera.functions.geodesy import LocalFrame
from tessera.operators import cache, eviction, hierarchy, quantiles
from tessera.plans.ingest_queries import container
from tessera.sources import glb

TREE = "tile_id long, parent_id long, ord long, uri string, ready boolean, in_view boolean, refine boolean, usable boolean, preload boolean"


def tree(spark, *rows):
    return spark.createDataFrame([(i, p, i, uri, ready, True, refine, True, True) for i, p, uri, ready, refine in rows], TREE)


@pytest.mark.parametrize(("mode", "want"), [("legacy", {(2, "selected"), (3, "requested"), (1, "gap")}), ("mixed", {(1, "selected"), (2, "selected"), (3, "requested")}), ("atomic", {(1, "selected"), (2, "immune"), (3, "requested")})])
def test_cut_of_half_ready_children(spark, mode, want):
    t = tree(spark, (1, None, "p.glb", True, True), (2, 1, "a.glb", True, False), (3, 1, "b.glb", False, False))
    assert {tuple(r) for r in hierarchy.select_cut(t, mode).collect()} == want


def test_cut_falls_back_and_sees_through_wrappers(spark):
    t = tree(spark, (1, None, "p.glb", True, True), (2, 1, "w.json", False, False), (3, 2, "a.glb", False, False))
    assert {tuple(r) for r in hierarchy.select_cut(t).collect()} == {(1, "selected"), (3, "requested")}


def test_lru_of_three(spark):
    rows = [(1, k, key, size) for k, (key, size) in enumerate([("a", 2), ("b", 2), ("a", 2), ("c", 3), ("b", 2), ("b", 2)])]
    got = cache.lru_hits(spark.createDataFrame(rows, "cache_id long, seq long, key string, size long"), 4).orderBy("seq").collect()
    assert [r.hit for r in got] == [False, False, True, False, False, True]


@pytest.mark.parametrize("newest_stays", [False, True])
def test_lru_equals_stack_distances(spark, newest_stays):
    rng = random.Random(6)
    size = {k: rng.randint(0, 30) for k in range(12)} | {None: 3}
    rows = [(c, s, k, size[k]) for c in (1, 2, None) for s, k in enumerate(rng.choices([*range(12), None], k=300))]
    got = cache.lru_hits(spark.createDataFrame(rows, "cache_id long, seq long, key long, size long"), 60, newest_stays).collect()
    want = set()
    for c in (1, 2, None):
        keys = [r[2] for r in rows if r[0] == c]
        for s, k in enumerate(keys):
            prev = max((p for p in range(s) if keys[p] == k), default=None)
            fits = prev is not None and (size[k] + sum(size[x] for x in set(keys[prev + 1 : s])) <= 60 or (newest_stays and prev == s - 1))
            want.add((c, s, k, prev, fits))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_evictions_by_hand(spark):
    cols = "session_id long, tile_id long, seq long, selected boolean, pinned boolean, immune boolean, walked boolean, age long, dist double, sse double, tier string"
    rows = [(1, t, t, t == 0, t == 1, None, t > 4, t if t < 4 else None, 100.0, float(t), "x") for t in range(8)] + [(None, t, t, None, None, None, None, 5, None, None, "x") for t in range(4)] + [(2, 1, 1, False, False, False, False, 9, 9.0, 9.0, "x")]
    got = {tuple(r) for r in eviction.two_tiers(spark.createDataFrame(rows, cols), 3).collect()}
    assert got == {(1, 3, 1), (1, 2, 1), (1, 4, 1), (1, 7, 2), (1, 6, 2), (None, 0, 1)}
    made = spark.createDataFrame([(1, 1, 1, 5.0, True, 100, 0), (1, 2, 2, 4.0, None, 10, None), (1, 3, 3, 4.0, False, 10, 1), (1, 4, 4, None, False, 10, 1), (2, 5, 5, 1.0, False, 5, 5)], "session_id long, tile_id long, seq long, score double, held boolean, source_bytes long, gpu_bytes long")
    assert [tuple(r) for r in eviction.under_caps(made, (9, 115, 99)).orderBy("place").collect()] == [(1, 2, 1), (1, 3, 2)]
    assert [r.tile_id for r in eviction.under_caps(made, (9, 50, 99)).orderBy("place").collect()] == [2, 3, 4]
    assert eviction.under_caps(made.limit(0), (1, 1, 1)).count() == 0


def test_nearest_ranks(spark):
    rng = random.Random(2)
    rows = [(k, v) for k in (1, 2, None) for v in rng.choices([1.0, 2.0, 5.0, 7.5, None], k=rng.randint(20, 90))] + [(3, None), (4, 8.0)]
    found = quantiles.nearest_rank(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}).collect()
    for r in found:
        values = sorted(v for k, v in rows if k == r.k and v is not None)
        assert tuple(r[1:]) == tuple(values[max(0, math.ceil(len(values) * f) - 1)] for f in (0.0, 0.5, 0.95, 1.0))
    assert {r.k for r in found} == {1, 2, None, 4}


def test_containers():
    assert glb.parse(container(3.0)) | {"reason": None} == {"supported": True, "reason": None, "primitives": 1, "vertices": 3, "triangles": 1, "low": [3.0, 0.0, 0.0], "high": [4.0, 0.0, 1.0], "image_bytes": 0, "stream_bytes": 48}
    for bad in (None, b"", container(0.0, 1), container(0.0)[:60], container(0.0, extensionsRequired=["X"]), container(0.0, buffers=[{"uri": "x"}])):
        assert not glb.parse(bad)["supported"] and glb.parse(bad)["reason"]


def test_frame_turns_back():
    frame = LocalFrame.at(21.7, 38.2, 100, yaw=30)
    x, y, z, w = frame.quaternion()
    assert abs(x * x + y * y + z * z + w * w - 1) < 1e-12


def test_quaternions_turn_as_their_matrices(spark):
    from pyspark.sql import functions as F

    from tessera.functions import motion

    for yaw, pitch, roll in ((0, 0, 0), (30, 20, 10), (170, 80, -60), (-100, 10, 175), (90, 0, 90), (180, 0, 0)):
        frame = LocalFrame.at(-70.0, 33.0, 5, yaw, pitch, roll)
        rows = tuple(zip(*frame.to_tile))
        x, y, z, w = spark.range(1).select(*motion.quaternion(tuple(tuple(F.lit(c) for c in row) for row in rows))).first()
        assert all(abs(p - q) < 1e-9 for p, q in zip((x, y, z, w), frame.quaternion()))
        back = ((1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)), (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)), (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)))
        assert all(abs(p - q) < 1e-9 for r, t in zip(back, rows) for p, q in zip(r, t))
        assert w > 0.5 or rows[0][0] + rows[1][1] + rows[2][2] <= 0


def test_entry_works(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["tile_id", "role"] and len(entry.queries()) > 30


def wave(spark, *rows):
    t = spark.createDataFrame([(i, p, i, uri, ready, True, refine, True, True, may, dead) for i, p, uri, ready, refine, may, dead in rows], TREE + ", may_hold boolean, dead boolean")
    return {tuple(r) for r in hierarchy.select_cut(t, "wave").collect()}


def test_wave_holds_advances_and_drops(spark):
    def rows(may, b_ready, b_dead):
        return (1, None, "p.glb", True, True, may, False), (2, 1, "a.glb", True, False, False, False), (3, 1, "b.glb", b_ready, False, None, b_dead)

    assert wave(spark, *rows(True, False, False)) == {(1, "selected"), (1, "held"), (2, "immune"), (3, "requested")}
    assert wave(spark, *rows(False, False, False)) == {(2, "selected"), (3, "requested"), (1, "gap")}
    assert wave(spark, *rows(True, True, False)) == {(2, "selected"), (3, "selected"), (1, "advanced")}
    assert wave(spark, *rows(True, False, True)) == {(2, "selected"), (3, "requested"), (1, "advanced")}


def test_wave_drops_a_fallback_to_an_advanced_tile(spark):
    # 2 is not ready and has nothing below, so it rides on 1; 3 is there: 1 isn't shown with its own finer piece.
    got = wave(spark, (1, None, "p.glb", True, True, True, False), (2, 1, "a.glb", False, True, False, False), (3, 1, "b.glb", True, False, False, False), (4, 2, "c.glb", False, False, False, False))
    assert got == {(3, "selected"), (1, "advanced"), (2, "requested"), (4, "requested")}
