"""Queries over state that rows hand on: the life of content, adaptive limits, slots, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import controllers, hierarchy, holds, legacy, preparation, samples, slots
from ..operators.lineage import scratch
from ..streaming import lifecycle, states, telemetry
from .fixtures import FRAMES, TILE_TABLE, duck, table, view
from .registry import query

#: A log of content events: most events move a load on, some ask, show, hide, drop or fail it.
_LOG = """SELECT user_id AS node_id, event_id AS seq, {ms} AS at_ms, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 4 = 3 THEN 'show' ELSE 'request' END
  WHEN 'purchase' THEN CASE event_id % 8 WHEN 0 THEN 'hide' WHEN 1 THEN 'abort' ELSE 'advance' END WHEN 'error' THEN 'fail' ELSE 'advance' END AS event,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 410 END END AS status FROM {source}"""


def _log(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(_LOG.format(ms="unix_millis(CAST(ts AS TIMESTAMP))", source="{events}"), events=events)


@query(lifecycle.LIFE.duck(_LOG.format(ms="epoch_us(ts) // 1000", source="events"), "node_id", "at_ms, seq"))
def k1_load_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each node after its log."""
    return lifecycle.replay(_log(table(spark, sf_dir, "events")))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, so a file will do


@query(lifecycle.LIFE.duck(_LOG.format(ms="epoch_us(ts) // 1000", source="events"), "node_id", "at_ms, seq"))
def k1_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the same states kept by a stream, and the last of each node."""
    stream = lifecycle.follow(_log(_stream(spark, sf_dir)))
    return telemetry.latest(telemetry.drain(stream, "update", scratch(spark, "stream")), ["node_id"])


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS name, count(*) AS count, round(sum(value), 4) AS total, max(value) AS maximum FROM events WHERE value >= 0 GROUP BY ALL""")
def s4_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4, F3 over a stream: metrics in windows of event time; all of the log comes in one go, so nothing is late."""
    stream = telemetry.windowed(_stream(spark, sf_dir))
    out = telemetry.latest(telemetry.drain(stream, "update", scratch(spark, "stream")), ["start", "name"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "name", "count", F.round("total", 4).alias("total"), "maximum")


_SAMPLES = f"""SELECT session_id, frame_no, value AS frame_cost, 40e0 AS target, frame_no / 9 AS long_tasks, event_id % 11 AS speed, event_id % 3 AS queued_decode, event_id % 13 AS downloaded_mb,
  event_id % 2 AS queued_prepare, event_id % 5 AS queued_network, (event_id % 90) / 1e2 AS heap, event_id % 50 = 7 AS pressure FROM ({FRAMES}) f"""
_EVERY = 2


@query(controllers.CONTROLLER.duck(_SAMPLES.replace("frame_no / 9", "frame_no // 9") + f" WHERE frame_no % {_EVERY} = 0", "session_id", "frame_no"))
def g15_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that back off under load and grow with headroom."""
    return controllers.control(view(spark, sf_dir, _SAMPLES.replace("frame_no / 9", "frame_no div 9")), "session_id", sample_frames=_EVERY)


@query()
def h2_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H3, H8: when each request of a session gets one of four slots."""
    e = table(spark, sf_dir, "events")
    requests = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("arrive"), (F.col("value") * 3600).alias("duration"), (F.col("event_id") * 31 % 100).alias("priority"))
    return slots.simulate(requests, 4)


_HOLDS = f"SELECT session_id, frame_no AS frame, event_type IN ('view', 'click', 'error') AND value < 60 AS candidate, event_id % 17 = 0 AS advanced FROM ({FRAMES}) f"
_CLOCK = (3, 5)


@query(holds.hold_clock(*_CLOCK).duck(_HOLDS, "session_id", "frame"))
def j5_hold_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a tile stood for its unfinished children, its episodes, and whether it may no longer."""
    return holds.hold_clock(*_CLOCK).run(view(spark, sf_dir, _HOLDS), "session_id", ["frame"])


_READS = """SELECT user_id AS cache_key, event_id, {ms} AS at_ms, CASE WHEN event_id % 6 = 1 THEN 0 ELSE 3600000 * (event_id % 200) END AS age_ms, event_id % 100 + 1 AS n_bytes, event_id % 4 > 0 AS tag, event_id % 3 = 0 AS unchanged,
  event_id % 6 > 0 AS keeps, CAST(floor(value * 360000) AS BIGINT) AS takes_ms FROM {source}"""
_MS = {"spark": "unix_millis(CAST(ts AS TIMESTAMP))", "duck": "epoch_us(ts) // 1000"}


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_READS.format(ms=_MS["spark"], source="{events}"), events=table(spark, sf_dir, "events"))


@query(holds.READS.duck(_READS.format(ms=_MS["duck"], source="events"), "cache_key", "at_ms, event_id"))
def k4_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5, K6: reads of each key that are fresh, stale, checked and fetched, and their bytes."""
    return holds.READS.run(_reads(spark, sf_dir), "cache_key", ["at_ms", "event_id"])


@query(holds.SHARED.duck(_READS.format(ms=_MS["duck"], source="events"), "cache_key", "at_ms, event_id"))
def k3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: fetches of each key, and the requests that joined one."""
    return holds.SHARED.run(_reads(spark, sf_dir), "cache_key", ["at_ms", "event_id"])


_FLAGGED = f"SELECT tile_id, parent_id, depth, uri, tile_id * 31 % 10 < 7 AS in_view, tile_id * 17 % 10 < 8 AS in_range, tile_id * 7919 % 10 < 8 AS loaded, tile_id % 3 <> 0 AS hidden, tile_id * 13 % 10 < 6 AND depth < 4 AS opened FROM ({TILE_TABLE}) t"


@query(f"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, coalesce(uri LIKE '%.glb%', false) AS glb FROM ({duck(_FLAGGED)}) q),
a AS (SELECT tile_id, tile_id AS above, 0 AS steps FROM t UNION ALL SELECT a.tile_id, t.parent_id, steps + 1 FROM a JOIN t ON above = t.tile_id WHERE t.parent_id IS NOT NULL),
v AS MATERIALIZED (SELECT a.tile_id, arg_min(above, steps) AS visual FROM a JOIN t ON above = t.tile_id WHERE glb GROUP BY a.tile_id),
lost AS (SELECT tile_id FROM t WHERE opened AND glb AND NOT loaded), live AS MATERIALIZED (SELECT t.*, visual FROM t LEFT JOIN v USING (tile_id) WHERE opened AND NOT (glb AND NOT loaded)),
gone AS MATERIALIZED (SELECT * FROM live WHERE NOT (in_view AND in_range) AND (glb OR visual IN (SELECT tile_id FROM t WHERE hidden AND tile_id NOT IN (SELECT tile_id FROM lost)))),
collapsed AS (SELECT tile_id FROM gone WHERE parent_id IS NULL OR parent_id NOT IN (SELECT tile_id FROM gone) UNION SELECT live.tile_id FROM live JOIN collapsed c ON live.parent_id = c.tile_id),
unloaded AS (SELECT tile_id FROM t WHERE parent_id IN (SELECT tile_id FROM collapsed)),
shown AS (SELECT DISTINCT visual AS tile_id FROM collapsed JOIN v USING (tile_id) WHERE visual NOT IN (SELECT tile_id FROM unloaded)),
stay AS (SELECT tile_id FROM live WHERE tile_id NOT IN (SELECT tile_id FROM collapsed)), inner_ AS (SELECT * FROM t WHERE in_view AND in_range AND tile_id IN (SELECT parent_id FROM t)),
walk AS (SELECT tile_id, 0 AS k FROM stay UNION SELECT i.tile_id, k + 1 FROM walk w JOIN inner_ i ON i.parent_id = w.tile_id WHERE k < 3),
opened AS (SELECT DISTINCT tile_id FROM walk WHERE k > 0 AND tile_id NOT IN (SELECT tile_id FROM stay)),
hides AS (SELECT DISTINCT above AS tile_id FROM a JOIN opened o ON a.tile_id = o.tile_id JOIN v ON v.tile_id = a.tile_id JOIN t ON t.tile_id = above WHERE glb AND (above = visual OR NOT hidden OR above IN (SELECT tile_id FROM shown)))
SELECT 'reconcile' AS action, tile_id FROM lost UNION ALL SELECT 'collapse', tile_id FROM collapsed UNION ALL SELECT 'unload', tile_id FROM unloaded UNION ALL SELECT 'show', tile_id FROM shown
UNION ALL SELECT 'expand', tile_id FROM opened UNION ALL SELECT 'load', tile_id FROM t WHERE NOT loaded AND parent_id IN (SELECT tile_id FROM opened) UNION ALL SELECT 'hide', tile_id FROM hides""")
def j13_legacy_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the expand and collapse driver does in a frame."""
    tiles = view(spark, sf_dir, _FLAGGED)
    return legacy.drive(tiles, hierarchy.flatten(tiles), tiles.where("opened"))


@query()
def h7_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame in which each job is prepared; tested on small queues."""
    jobs = view(spark, sf_dir, f"SELECT session_id, event_id AS seq, frame_no AS frame, event_id * 31 % 100 AS priority, event_id % 5 AS textures, event_id % 7 AS meshes FROM ({FRAMES}) f")
    return preparation.simulate(jobs)


_EVENT = "CASE event_id % 11 WHEN 0 THEN 'queue' WHEN 1 THEN 'track' WHEN 2 THEN 'unload' WHEN 3 THEN 'reprobe' WHEN 4 THEN 'force' WHEN 5 THEN CASE WHEN event_id % 4 = 0 THEN 'forget' END WHEN 6 THEN 'unload' ELSE 'resolve' END"
_PROBES = f"SELECT user_id AS sample_id, event_id AS seq, {_EVENT} AS event, CASE WHEN event_id % 4 > 0 THEN event_id % 3 END AS mesh, CASE WHEN event_id % 4 > 0 THEN value END AS height FROM {{source}}"


def _probes(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(_PROBES.format(source="{events}"), events=events)


_REGISTRY_SQL = samples.REGISTRY.duck(_PROBES.format(source="events"), "sample_id", "seq")


@query(f"SELECT *, pending = 1 OR (active = 1 AND alive = 0) AS needs_resample FROM ({_REGISTRY_SQL}) r")
def k18_ground_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground samples that wait, stand on a mesh, are probed again or demoted."""
    return samples.registry(_probes(table(spark, sf_dir, "events")))


@query(_REGISTRY_SQL)
def k18_ground_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same registry kept by a stream."""
    stream = states.follow(_probes(_stream(spark, sf_dir)), "sample_id", ["seq"], samples.REGISTRY, samples.START, ["event", "mesh", "height"], samples.step)
    return telemetry.latest(telemetry.drain(stream, "update", scratch(spark, "stream")), ["sample_id"])


_ASKED = "SELECT user_id AS session_id, {ms} // 40000 AS at_ms FROM {source}"


@query(samples.PASSES.duck(_ASKED.format(ms=_MS["duck"], source="events"), "session_id", "at_ms"))
def g14_debounced_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes over the registry that run, and those that come too soon after one."""
    asked = spark.sql(_ASKED.replace("//", "div").format(ms=_MS["spark"], source="{events}"), events=table(spark, sf_dir, "events"))
    return samples.PASSES.run(asked, "session_id", ["at_ms"])


@query("""SELECT 'kept' AS state, count(*) AS samples FROM events WHERE event_id % 7 > 0 UNION ALL SELECT CASE WHEN event_id % 7 > 0 THEN 'alive' ELSE 'dead' END, count(*) FROM events GROUP BY ALL""")
def e10_unloaded_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached samples that stay, and active ones that stand on nothing, when meshes leave."""
    cached = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 700).alias("mesh"))
    kept, marked = samples.unloaded(cached, spark.range(0, 700, 7).withColumnRenamed("id", "mesh"))
    states_ = kept.select(F.lit("kept").alias("state")).unionAll(marked.select(F.when(F.col("alive"), "alive").otherwise("dead").alias("state")))
    return states_.groupBy("state").agg(F.count(F.lit(1)).alias("samples"))
