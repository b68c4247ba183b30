"""Rules of a frame and of caches against plain loops, on nulls, ties, repeated rows and empty tables."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import failures, frames, hierarchy, tiers


def test_tree_of_seventy_levels(spark):
    rows = [(k, k - 1 if k else None, "t.glb" if k == 70 else None, k) for k in range(71)] + [(200, 201, None, 0), (201, 200, None, 0)]
    tiles = spark.createDataFrame(rows, "tile_id long, parent_id long, uri string, ord long")
    flat = {r.tile_id: r for r in hierarchy.flatten(tiles).collect()}
    assert sorted(flat) == list(range(71)) and flat[70].depth == 70 and flat[70].path == list(range(71))
    few = tiles.where("tile_id between 63 and 70").withColumn("parent_id", F.when(F.col("tile_id") > 63, F.col("parent_id")))
    assert {(r.tile_id, r.piece) for r in hierarchy.frontier(few).collect()} == {(k, 70) for k in range(63, 70)}


def asked_by_hand(rows):
    times, last, refreshes, counted = [], -10**12, 0, 0
    for at, counts in sorted(rows):
        if not counts:
            continue
        counted += 1
        times = [t for t in [*times, at] if t >= at - 10_000]
        if len(times) >= 5 and at - last >= 30_000:
            times, last, refreshes = [], at, refreshes + 1
    return refreshes, counted


def test_refreshes_like_a_window_with_cooldown(spark):
    rng = random.Random(2)
    logs = {s: sorted({(rng.randrange(0, 200_000), rng.random() < 0.8) for _ in range(n)}) for s, n in enumerate((0, 1, 4, 5, 60, 200))}
    log = spark.createDataFrame([(s, at, c) for s, rows in logs.items() for at, c in rows], "source_id int, at_ms long, counts boolean")
    got = {r.source_id: (r.refreshes, r.counted) for r in failures.refreshes().run(log, "source_id", ["at_ms"]).collect()}
    assert got == {s: asked_by_hand(rows) for s, rows in logs.items() if rows} and got[5][0] > 2
    assert failures.refreshes().run(log.limit(0), "source_id", ["at_ms"]).collect() == []


def test_session_failures_go_by_the_body(spark):
    rows = [(401, None), (404, "Session expired"), (404, "not here"), (500, "INVALID ARGUMENT"), (None, None), (None, "invalid session"), (503, "session")]
    made = spark.createDataFrame(rows, "status int, body string")
    got = [r.f for r in made.select(failures.session_failure(F.col("status"), F.col("body")).alias("f")).collect()]
    assert got == [(s in (400, 401, 403)) or bool(re.search(failures.WORDS, b or "", re.I)) for s, b in rows]


def test_memory_gives_up_the_oldest_that_may_go(spark):
    rng = random.Random(6)
    rows = [(c, k, rng.choice((None, 1, 5, 9)), rng.choice((True, True, False, None)), rng.choice((0, 0, 1, None))) for c in range(5) for k in range(30)]
    want = set()
    for c in range(5):
        own = [r for r in rows if r[0] == c]
        held = sum(r[2] or 0 for r in own)
        for _, k, size, settled, waiters in own:
            if held <= 60:
                break
            if settled and not waiters:
                want.add((c, k))
                held -= size or 0
    made = spark.createDataFrame(rows, "cache_id int, seq int, size long, settled boolean, waiters int")
    assert {(r.cache_id, r.seq) for r in tiers.given_up(made, 60, "cache_id", "seq").where("evicted").collect()} == want
    assert tiers.given_up(made.limit(0), 60, "cache_id", "seq").collect() == []


def test_probe_of_two_levels(spark):
    asked = spark.createDataFrame([(1, None), (2, False), (3, False), (None, False), (1, True), (1, False)], "key int, bypass boolean")
    memory, store = spark.createDataFrame([(1, 10)], "key int, size long"), spark.createDataFrame([(1, 11), (2, 20)], "key int, size long")
    got = sorted(((r.key, r.bypass, r.answered, r.found) for r in tiers.probe(asked, memory, store, ["key"]).collect()), key=str)
    assert got == sorted([(1, None, "l1", 10), (2, False, "l2", 20), (3, False, "origin", None), (None, False, "origin", None), (1, True, "bypass", None), (1, False, "l1", 10)], key=str)
    rates = tiers.hit_rates(tiers.probe(asked, memory, store, ["key"]).withColumn("c", F.lit(1)), "c").first()
    assert (rates.l1_hits, rates.l2_hits, rates.misses, rates.bypasses, rates.hit_rate) == (2, 1, 2, 1, 0.6)


def test_counts_of_shown_tiles(spark):
    rng = random.Random(4)
    rows = [(s, n, rng.randrange(4), rng.choice((True, False, None))) for s in range(3) for n in range(40)]
    want = {}
    for s in range(3):
        shown = set()
        for _, n, tile, shows in (r for r in rows if r[0] == s):
            if shows is not None:
                (shown.add if shows else shown.discard)(tile)
            want[s, n] = len(shown)
    log = spark.createDataFrame(rows, "session_id int, n int, tile int, shows boolean")
    assert {(r.session_id, r.n): r.visible for r in frames.visible_count(log, "session_id", ["n"]).collect()} == want


def test_hides_wait_for_a_second_thought(spark):
    chosen = {1: {1, 2}, 2: {1}, 3: {1, 2}, 4: {1}, 5: set(), 6: set(), 7: {3}}
    for after in (0, 1, 2):
        pending, hidden, before = {}, set(), set()
        for f in sorted(chosen):
            pending |= {t: f for t in before - chosen[f]}
            for t, at in list(pending.items()):
                if t in chosen[f]:
                    del pending[t]
                elif f - at >= after:
                    hidden.add((t, f))
                    del pending[t]
            before = chosen[f]
        selected = spark.createDataFrame([(0, f, t) for f, own in chosen.items() for t in own], "session_id int, frame_no long, tile int")
        every = spark.createDataFrame([(0, f) for f in chosen], "session_id int, frame_no long")
        assert {(r.tile, r.hidden_at) for r in frames.hidden_later(selected, every, after).collect()} == hidden


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, 5, 0, 2.0, False), (1, 6, 1, 9.0, False), (1, 7, 2, 9.0, False), (1, 6, 3, 1.0, True), (2, 8, 0, None, False)], "session_id int, job int, seq int, priority double, done boolean")
    assert {(r.session_id, r.job) for r in frames.next_job(jobs, F.col("priority") > 0).collect()} == {(1, 6)}
    live = frames.live_jobs(jobs, ["session_id", "job"], "seq")
    assert {r.job for r in live.collect()} == {5, 7, 8}
    new = spark.createDataFrame([(1, 5, 50.0), (1, 99, 1.0)], "session_id int, job int, priority double")
    assert {(r.job, r.priority) for r in frames.refreshed(live, new, ["session_id", "job"]).collect()} == {(5, 50.0), (7, 9.0), (8, None)}
    assert frames.wanted(jobs, jobs, jobs, ["job"]).count() == 4
