"""State machines, streams and queues against plain loops."""

import random

from tessera.operators import hierarchy, legacy, preparation, samples, slots
from tessera.plans import catalog
from tessera.plans.stateful_queries import _log
from tessera.streaming import lifecycle, telemetry

SF_DIR = "/root/testdata/sf0.001"


def test_life_of_a_node(spark):
    log = [(1, 0, "request", None), (1, 1, "advance", None), (1, 2, "fail", 404), (1, 3, "request", None), (1, 600, "request", None), *[(1, 601 + k, "advance", None) for k in range(6)], (1, 700, "show", None), (1, 701, "hide", None), (1, 702, None, None)]
    df = spark.createDataFrame([(n, at, at, e, s) for n, at, e, s in log], "node_id long, at_ms long, seq long, event string, status long")
    got = lifecycle.replay(df).first().asDict()
    assert got == {"node_id": 1, "stage": 9, "failures": 0, "due_ms": 0, "requested": 2, "deferred": 1, "completed": 1, "recovered": 1, "cancelled": 0, "failed": 1, "unloaded": 0}
    assert lifecycle.replay(df.limit(0)).count() == 0


def test_fold_equals_steps(spark):
    rng = random.Random(5)
    kinds = ["request", "advance", "advance", "advance", "advance", "show", "hide", "abort", "fail", None]
    log = [(k % 7, at, at, rng.choice(kinds), rng.choice([404, 500, None])) for k, at in enumerate(sorted(rng.sample(range(200000), 3000)))]
    df = spark.createDataFrame(log, "node_id long, at_ms long, seq long, event string, status long")
    want = {k: dict.fromkeys(lifecycle.FIELDS, 0) for k in range(7)}
    for node, at, _, event, status in log:
        want[node] = lifecycle.step(want[node], at, event, status)
    assert {r.node_id: {f: r[f] for f in lifecycle.FIELDS} for r in lifecycle.replay(df).collect()} == want
    assert any(s["completed"] and s["failed"] for s in want.values())


def test_stream_keeps_state_over_batches(spark, tmp_path):
    log = _log(spark.read.parquet(f"{SF_DIR}/events.parquet"))
    cuts = [0, *log.selectExpr("percentile_disc(0.5) within group (order by at_ms)").first(), 1 << 60]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        log.where(f"at_ms >= {low} and at_ms < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = telemetry.drain(lifecycle.follow(stream), "update", str(tmp_path / "out"))
    assert batches.select("batch_id").distinct().count() == 2
    got = telemetry.latest(batches, ["node_id"])
    want = lifecycle.replay(log)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def plain_slots(requests, n):
    """Moves time from one event to the next and looks through lists."""
    todo, waiting, running, out = list(requests), [], [], []
    while todo or waiting or running:
        now = min([r[1] for r in todo[:1]] + running)
        while running and min(running) <= now:
            running.remove(min(running))
            if waiting:
                best = min(waiting, key=lambda r: (-r[3], r[0]))
                waiting.remove(best)
                out.append((best[0], now))
                running.append(now + best[2])
        while todo and todo[0][1] <= now and not (running and min(running) <= now):
            r = todo.pop(0)
            if len(running) < n:
                out.append((r[0], now))
                running.append(now + r[2])
            else:
                waiting.append(r)
    return out


def test_slots_equal_a_plain_loop(spark):
    rng = random.Random(3)
    made = {s: [(k, float(k // 2 * 3), float(rng.randint(1, 20)), float(rng.randint(0, 4))) for k in range(150)] for s in range(5)}
    rows = [(s, *r, "x") for s, rs in made.items() for r in rs] + [(None, 1, 1.0, 1.0, 1.0, "x"), (9, 1, None, 1.0, 1.0, "x"), (8, 1, 2.0, None, None, "x")]
    df = spark.createDataFrame(rows, "session_id long, seq long, arrive double, duration double, priority double, start string")
    got = slots.simulate(df, 3).collect()
    for s, rs in made.items():
        assert sorted((r.seq, r.start) for r in got if r.session_id == s) == sorted(plain_slots(rs, 3))
    assert [(r.start, r.finish, r.waited) for r in got if r.session_id == 8] == [(2.0, 2.0, 0.0)]
    assert slots.simulate(df.limit(0), 3).count() == 0


def test_controller_moves(spark):
    got = catalog.queries()["g15_controller"](spark, SF_DIR).collect()
    assert len({r.reason for r in got}) > 2 and all(6 <= r.decodes <= 12 and 0.35 <= r.resident_scale <= 1 for r in got)


def test_driver_expands_and_collapses(spark):
    # 1 (shown) has 2, 3; 2 has 4; 4 has 5.  2 was expanded and left the range; 3 has no children.
    cols = "tile_id long, parent_id long, uri string, in_view boolean, in_range boolean, loaded boolean, hidden boolean"
    rows = [(1, None, "a.glb", True, True, True, True), (2, 1, "b.glb", True, False, True, True), (3, 1, "c.glb", True, True, True, False), (4, 2, "d.glb", True, True, True, None), (5, 4, "e.glb", True, True, False, False)]
    tiles = spark.createDataFrame(rows, cols)
    paths = hierarchy.flatten(tiles)

    def actions(*expanded):
        got = legacy.drive(tiles, paths, spark.createDataFrame([(e,) for e in expanded], "tile_id long"))
        return {(r.action, r.tile_id) for r in got.collect()}

    assert actions(1, 2, 4) == {("collapse", 2), ("collapse", 4), ("unload", 4), ("unload", 5), ("show", 2)}
    assert actions(5) == {("reconcile", 5)}
    assert actions() == set()
    assert actions(2, 2) == {("collapse", 2), ("unload", 4), ("show", 2)}


def test_failures_are_reset_below(spark):
    tiles = spark.createDataFrame([(1, None, 2, 9, True), (2, 1, 3, 9, True), (3, None, 4, 9, None)], "tile_id long, parent_id long, failures int, retry_at long, dead boolean")
    got = legacy.reset_failures(tiles, spark.createDataFrame([(1,)], "tile_id long"), hierarchy.flatten(tiles)).orderBy("tile_id").collect()
    assert [(r.failures, r.retry_at, r.dead) for r in got] == [(0, None, False), (0, None, False), (4, 9, None)]


def test_preparation_keeps_its_budgets(spark):
    one = preparation.Limits(costs=(1.0,) * 6, budget_ms=3.0)
    assert list(preparation.prepare([(0, 1, 0.0, 1, 1)], one)) == [(1, 0, 1, 6)]
    assert list(preparation.prepare([(0, 1, 0.0, 5, 0)], preparation.Limits(budget_ms=1000.0))) == [(1, 0, 2, 8)]  # two textures a frame
    assert [r[0] for r in preparation.prepare([(0, 1, 1.0, 0, 0), (0, 2, 9.0, 0, 0), (0, 3, 9.0, 0, 0)], one)] == [2, 3, 1]
    assert [r[0] for r in preparation.prepare([(0, 1, 1.0, 0, 0), (0, 2, 2.0, 0, 0), (0, 3, 9.0, 0, 0)], preparation.Limits(jobs=1))] == [1, 3, 2]
    late = preparation.Limits(costs=(9.0,) * 6, budget_ms=1.0, deferral_ms=32.0)  # no step fits, so the first runs when it has waited
    assert list(preparation.prepare([(5, 1, 0.0, 0, 0)], late))[0][2] >= 7
    df = spark.createDataFrame([(s, k, k // 3, float(k % 4), 1, 2, "x") for s in range(3) for k in range(60)] + [(None, 1, 1, 1.0, 1, 1, "x"), (7, 1, 4, None, None, None, "x")], "session_id long, seq long, frame long, priority double, textures long, meshes long, steps string")
    got = preparation.simulate(df).collect()
    assert len(got) == 181 and len({(r.session_id, r.seq) for r in got}) == 181 and all(r.done_frame >= r.frame for r in got)
    assert preparation.simulate(df.limit(0)).count() == 0


def test_registry_equals_steps(spark):
    rng = random.Random(8)
    kinds = [*samples.EVENTS, "resolve", "resolve", "unload", None, "other"]
    log = [(rng.randrange(6), k, rng.choice(kinds), rng.choice([1, 2, None]), float(rng.randrange(50))) for k in range(2500)]
    want = {k: samples.START for k in range(6)}
    for sample, _, event, mesh, height in log:
        want[sample] = samples.step(want[sample], event, mesh, height)
    df = spark.createDataFrame([(*r, "x") for r in log], "sample_id long, seq long, event string, mesh long, height double, pending string")
    got = samples.registry(df).collect()
    assert {r.sample_id: {f: r[f] for f in samples.FIELDS} for r in got} == want
    assert sum(s["demoted"] for s in want.values()) > 9 and sum(s["resolved"] for s in want.values()) > 99
    assert samples.registry(df.limit(0)).count() == 0


def test_registry_by_hand():
    def after(*events):
        s = samples.START
        for e in events:
            s = samples.step(s, *e)
        return s["pending"], s["active"], s["alive"], s["ground"]

    assert after(("queue", None, None), ("resolve", None, None)) == (1, 0, 0, None)
    assert after(("queue", None, None), ("resolve", 4, 2.5)) == (0, 1, 1, 2.5)
    assert after(("track", 4, 2.5), ("unload", 4, None), ("reprobe", None, None)) == (1, 0, 0, 2.5)
    assert after(("track", 4, 2.5), ("force", None, None)) == (0, 1, 1, 2.5)
    assert after(("track", 4, 2.5), ("reprobe", 5, 9.0)) == (0, 1, 1, 2.5)
    assert after(("track", 4, 2.5), ("unload", 5, None), ("unload", 4, None), ("resolve", 5, 9.0)) == (0, 1, 1, 9.0)


def test_long_keys_are_walked_with_the_same_result(spark):
    from tessera.operators import controllers, folds, holds
    from tessera.plans import stateful_queries as sq
    from tessera.plans.fixtures import view
    from tessera.plans.motion_queries import _CREEP, IDLE

    log = _log(spark.read.parquet(f"{SF_DIR}/events.parquet"))
    probes = sq._probes(spark.read.parquet(f"{SF_DIR}/events.parquet"))
    frames = view(spark, SF_DIR, sq._SAMPLES.replace("frame_no / 9", "frame_no div 9"))
    cases = [
        (lifecycle.LIFE, log, "node_id", ["at_ms", "seq"]), (samples.REGISTRY, probes, "sample_id", ["seq"]), (controllers.CONTROLLER, frames, "session_id", ["frame_no"]),
        (holds.hold_clock(3, 5), view(spark, SF_DIR, sq._HOLDS), "session_id", ["frame"]), (holds.hold_clock(3, 0), view(spark, SF_DIR, sq._HOLDS), "session_id", ["frame"]),
        (holds.READS, sq._reads(spark, SF_DIR), "cache_key", ["at_ms", "event_id"]), (holds.SHARED, sq._reads(spark, SF_DIR), "cache_key", ["at_ms", "event_id"]), (IDLE, view(spark, SF_DIR, _CREEP), "session_id", ["frame_no"]),
    ]
    for machine, df, key, order in cases:
        df = df.unionByName(df.where(f"{key} % 7 = 0").withColumn(key, df[key] * 0)).withColumn(key, df[key] - 1).selectExpr(f"nullif({key}, -1) AS {key}", *[c for c in df.columns if c != key])
        want = sorted(map(tuple, machine.run(df, key, order).collect()), key=repr)
        typical = df.groupBy(key).count().selectExpr("percentile_disc(0.6) within group (order by count)").first()[0]
        got = sorted(map(tuple, machine.run(df, key, order, most_rows=typical).collect()), key=repr)
        assert got == want and len(got) > 5
    assert isinstance(folds.MOST_ROWS, int)


def test_averages_in_blocks_equal_a_loop(spark):
    from pyspark.sql import functions as F

    from tessera.operators import folds

    rng = random.Random(4)
    rows = [(k % 3, k, rng.choice([None, *[rng.random() * 80 for _ in range(12)]])) for k in range(3000)] + [(9, 1, None)]
    df = spark.createDataFrame(rows, "key long, seq long, value double")
    found = {"mean": folds.Average(F.col("value"), None, folds.ewma(0.5)), "slow": folds.Average(F.col("value"), 16.0, folds.ewma(0.99)), "memory": folds.Average(F.col("value") / 40, 1.0, folds.memory_bias), "frame": folds.Average(F.col("value") / 16, 1.0, folds.frame_bias)}
    for width in (1, 40, 10**9):
        got = {r.key: r for r in folds.averages(df, ["key"], ["seq"], F.floor(F.col("seq") / width), found).collect()}
        for key in range(3):
            mean, slow, memory, frame = None, 16.0, 1.0, 1.0
            for _, _, v in (r for r in rows if r[0] == key and r[2] is not None):
                mean = v if mean is None else 0.5 * mean + 0.5 * v
                slow = 0.99 * slow + 0.01 * v
                memory = min(10, memory * 1.1) if v / 40 > 1.3 else max(1, memory * 0.98)
                frame = min(3, frame * 1.05) if v / 16 > 1.5 else max(1, frame * 0.97) if v / 16 < 1.1 else frame
            assert all(abs(x - y) < 1e-9 for x, y in zip((mean, slow, memory, frame), got[key][1:]))
        assert tuple(got[9][1:]) == (None, 16.0, 1.0, 1.0)


def test_steps_read_nulls_as_sql():
    from tessera.operators.steps import compiled

    def value(text, **b):
        return compiled(text)({}, b)

    assert value("b.x = 1 OR TRUE", x=None) is True and value("b.x = 1 AND TRUE", x=None) is None and value("NOT b.x IN (1, 2)", x=3) is True
    assert value("CASE WHEN b.x > 0 THEN 1 END", x=None) is None and value("least(b.x, 4) - 2 * 3", x=None) == -2
    assert value("b.x IS NOT NULL", x=0) is True and value("pow(2, 3) / 4 + 1e0") == 3.0
