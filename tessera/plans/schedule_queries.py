"""Queries over requests and residents: dispatch, budgets, preemption, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import devices
from ..operators import eviction
from .fixtures import ACCESSES, FRAMES, view
from .registry import query

#: Requests: one for each access, with a priority and a class.
_REQUESTS = f"SELECT cache_id AS session_id, seq, key AS tile_id, event_id, event_id * 31 % 1000 / 1e1 AS priority, event_id % 5 AS class_rank, value FROM ({ACCESSES}) q"


@query(f"SELECT session_id, seq, tile_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, seq) AS place FROM ({_REQUESTS}) r WHERE tile_id % 10 <> 3) WHERE place <= 16")
def h1_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen best requests of a session that aren't ready; ties in order of arrival."""
    w = Window.partitionBy("session_id").orderBy(F.desc("priority"), "seq")
    return view(spark, sf_dir, _REQUESTS).where("tile_id % 10 <> 3").withColumn("place", F.row_number().over(w)).where("place <= 16").select("session_id", "seq", "tile_id", "place")


@query(f"SELECT session_id, tile_id, max(priority) AS priority, CAST(arg_max(class_rank, (priority, -seq)) AS BIGINT) AS class_rank, CAST(max(class_rank) AS BIGINT) AS upgraded FROM ({_REQUESTS}) r GROUP BY session_id, tile_id")
def i6_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each tile: its highest priority with that one's class, the first of ties; classes of jobs only rise."""
    return view(spark, sf_dir, _REQUESTS).groupBy("session_id", "tile_id").agg(F.max("priority").alias("priority"), F.max_by("class_rank", F.struct("priority", (-F.col("seq")).alias("s"))).alias("class_rank"), F.max("class_rank").alias("upgraded"))


@query(f"""SELECT session_id, arg_min(seq, (class_rank, priority, seq)) AS victim, count(*) FILTER (WHERE class_rank >= 3) AS critical_jobs, count(*) FILTER (WHERE class_rank >= 3) > 0 AS critical FROM ({_REQUESTS}) r GROUP BY session_id""")
def h5_preemption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that a better one would preempt, and the jobs that matter for what is seen."""
    return view(spark, sf_dir, _REQUESTS).groupBy("session_id").agg(F.min_by("seq", F.struct("class_rank", "priority", "seq")).alias("victim"), F.count_if(F.col("class_rank") >= 3).alias("critical_jobs"), (F.count_if(F.col("class_rank") >= 3) > 0).alias("critical"))


@query(f"SELECT session_id, seq, CAST(coalesce(sum(tile_id) OVER (PARTITION BY session_id ORDER BY priority DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent, coalesce(sum(tile_id) OVER (PARTITION BY session_id ORDER BY priority DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 600 AS runs FROM ({_REQUESTS}) r")
def h6_time_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H4: jobs run in order of priority as long as what ran before is below the budget."""
    before = F.coalesce(F.sum("tile_id").over(Window.partitionBy("session_id").orderBy(F.desc("priority"), "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return view(spark, sf_dir, _REQUESTS).select("session_id", "seq", before.alias("spent"), (before < 600).alias("runs"))


@query(f"""WITH j AS (SELECT session_id, tile_id, max(seq) AS last_wanted, min(class_rank) AS class_rank FROM ({_REQUESTS}) r GROUP BY ALL), n AS (SELECT session_id, max(seq) AS now FROM ({_REQUESTS}) r GROUP BY ALL)
SELECT session_id, tile_id, now - last_wanted AS stale, now - last_wanted > CASE WHEN class_rank = 0 THEN 2 ELSE 11 END AS cancelled FROM j JOIN n USING (session_id) WHERE last_wanted < now""")
def e7_stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that are no longer wanted are cancelled after twelve frames, speculative ones after two."""
    r = view(spark, sf_dir, _REQUESTS)
    jobs = r.groupBy("session_id", "tile_id").agg(F.max("seq").alias("last_wanted"), F.min("class_rank").alias("class_rank"))
    now = r.groupBy("session_id").agg(F.max("seq").alias("now"))
    stale = F.col("now") - F.col("last_wanted")
    return jobs.join(now, "session_id").where("last_wanted < now").select("session_id", "tile_id", stale.alias("stale"), (stale > F.when(F.col("class_rank") == 0, 2).otherwise(11)).alias("cancelled"))


@query(f"""WITH m AS (SELECT session_id, tile_id, max(seq) AS last, max(class_rank) AS k, count(*) AS n FROM ({_REQUESTS}) r GROUP BY ALL), a AS (SELECT *, max(last) OVER (PARTITION BY session_id) - last AS age FROM m),
s AS (SELECT *, round(age + log2(2e0 + tile_id) - 0.35 * k, 9) AS score, row_number() OVER (PARTITION BY session_id ORDER BY round(age + log2(2e0 + tile_id) - 0.35 * k, 9) DESC, last) AS place, count(*) OVER (PARTITION BY session_id) - 30 AS over FROM a WHERE tile_id % 7 <> 0)
SELECT session_id, tile_id, round(score, 6) AS score, place <= over AS evicted FROM s""")
def h14_resident_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residents by age, distance and depth; the worst go until thirty are left, protected ones excluded."""
    m = view(spark, sf_dir, _REQUESTS).groupBy("session_id", "tile_id").agg(F.max("seq").alias("last"), F.max("class_rank").alias("k"))
    w = Window.partitionBy("session_id")
    m = m.withColumn("age", F.max("last").over(w) - F.col("last")).where("tile_id % 7 <> 0").withColumn("score", F.round(F.col("age") + F.log2(2.0 + F.col("tile_id")) - 0.35 * F.col("k"), 9))
    m = m.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "last"))).withColumn("over", F.count(F.lit(1)).over(w) - 30)
    return m.select("session_id", "tile_id", F.round("score", 6).alias("score"), (F.col("place") <= F.col("over")).alias("evicted"))


@query(f"""SELECT session_id, frame_no, CASE WHEN event_type = 'view' THEN 'mobile' WHEN event_type = 'click' THEN 'xr' ELSE 'desktop' END AS profile, CASE WHEN event_type = 'view' THEN 20e0 WHEN event_type = 'click' THEN 13.89e0 ELSE 16.67e0 END AS target_ms,
CAST(greatest(4, least(24, event_id % 32)) AS BIGINT) AS decode_slots FROM ({FRAMES}) q""")
def d13_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a device profile targets, and decode slots from 4 to 24."""
    f = view(spark, sf_dir, FRAMES)
    mobile, xr = F.col("event_type") == "view", F.col("event_type") == "click"
    return f.select("session_id", "frame_no", F.when(mobile, "mobile").when(xr, "xr").otherwise("desktop").alias("profile"), F.when(mobile, 20.0).when(xr, 13.89).otherwise(16.67).alias("target_ms"), F.greatest(F.lit(4), F.least(F.lit(24), F.col("event_id") % 32)).cast("long").alias("decode_slots"))


_LOADED = f"SELECT session_id, seq, tile_id, tile_id % 5 = 0 AS selected, tile_id % 11 = 0 AS pinned, tile_id % 13 = 0 AS immune, event_id % 3 = 0 AS walked, event_id % 50 AS age, event_id % 70 * 1e2 AS dist, event_id * 31 % 997 / 1e1 AS sse FROM ({_REQUESTS}) r"


@query(f"""WITH l AS ({_LOADED}), r AS (SELECT l.*, n, CASE WHEN walked THEN 2 ELSE 1 END AS tier, row_number() OVER (PARTITION BY l.session_id ORDER BY walked, CASE WHEN walked THEN sse ELSE age + 0.01e0 * dist END DESC, seq) AS place
  FROM l JOIN (SELECT session_id, count(*) AS n FROM l GROUP BY ALL) c USING (session_id) WHERE NOT (selected OR pinned OR immune)) SELECT session_id, tile_id, tier FROM r WHERE n > 20 * 1.3e0 AND place <= n - 20""")
def h9_two_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes when a third more than the limit is loaded: what the walk didn't reach, then the finest."""
    return eviction.two_tiers(view(spark, sf_dir, _LOADED), 20)


_RESIDENTS = f"SELECT session_id, seq, tile_id, event_id % 60 + class_rank * 0.35e0 AS score, tile_id % 6 = 0 AS held, CAST(event_id % 40 AS BIGINT) AS source_bytes, CAST(event_id % 90 AS BIGINT) AS gpu_bytes FROM ({_REQUESTS}) r"


@query(f"""WITH r AS ({_RESIDENTS}), t AS (SELECT session_id, count(*) AS t0, sum(source_bytes) AS t1, sum(gpu_bytes) AS t2 FROM r GROUP BY ALL),
g AS (SELECT session_id, tile_id, t0, t1, t2, row_number() OVER w AS place, coalesce(sum(source_bytes) OVER p, 0) AS g1, coalesce(sum(gpu_bytes) OVER p, 0) AS g2 FROM r JOIN t USING (session_id) WHERE NOT held
  WINDOW w AS (PARTITION BY session_id ORDER BY score DESC, seq), p AS (PARTITION BY session_id ORDER BY score DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, tile_id, CAST(place AS INTEGER) AS place FROM g WHERE t0 - (place - 1) > 40 OR t1 - g1 > 700 OR t2 - g2 > 1500""")
def h14_three_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residents that go, the worst first, until tiles and both sums of bytes are within their caps."""
    return eviction.under_caps(view(spark, sf_dir, _RESIDENTS), (40, 700, 1500))


@query(f"SELECT session_id, seq, tile_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM ({_REQUESTS}) r WHERE class_rank = 0 AND tile_id % 10 < 6) WHERE place <= 8")
def h15_speculative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight speculative requests of a session for tiles that aren't ready."""
    r = view(spark, sf_dir, _REQUESTS).where("class_rank = 0")
    return eviction.first_of(r, 8, "session_id", ["seq"], F.col("tile_id") % 10 < 6).select("session_id", "seq", "tile_id", "place")


@query(f"SELECT session_id, seq, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM ({_REQUESTS}) r WHERE NOT (class_rank = 4 OR tile_id % 7 = 0)) WHERE place <= 12")
def h18_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pending samples that a budget of twelve rays probes, without those that are skipped."""
    return eviction.first_of(view(spark, sf_dir, _REQUESTS), 12, "session_id", ["seq"], ~((F.col("class_rank") == 4) | (F.col("tile_id") % 7 == 0))).select("session_id", "seq", "place")


@query(f"SELECT session_id, seq, 200 + coalesce(sum(tile_id) OVER (PARTITION BY session_id ORDER BY priority DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 900 AS admitted FROM ({_REQUESTS}) r")
def h4_waiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiters that go on as long as bytes are below the threshold, the best first."""
    return eviction.admitted(view(spark, sf_dir, _REQUESTS).withColumn("n_bytes", F.col("tile_id")), "session_id", F.lit(200), 900).select("session_id", "seq", "admitted")


_DEVICES = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'xr' WHEN 1 THEN 'mobile' WHEN 2 THEN 'desktop' END AS profile, CASE WHEN event_id % 9 > 0 THEN event_id % 33 END AS cores, CASE WHEN event_id % 8 > 0 THEN event_id % 19 END AS memory FROM events"


@query(f"""WITH d AS (SELECT event_id, coalesce(profile, 'desktop') AS p, coalesce(cores, 4) AS c, coalesce(memory, 0) AS m FROM ({_DEVICES}) q), t AS (SELECT *, greatest(1, c) AS k, CASE WHEN p = 'xr' THEN 1 WHEN p = 'mobile' THEN CASE WHEN m >= 8 OR c >= 12 THEN 3 ELSE 2 END WHEN m >= 16 OR c >= 24 THEN 6 WHEN m >= 8 AND c >= 16 THEN 5 ELSE 4 END AS i FROM d)
SELECT event_id, CAST(CASE p WHEN 'xr' THEN greatest(2, least(3, floor(k * 0.38e0))) WHEN 'mobile' THEN greatest(2, least(4, floor(k * 0.42e0))) ELSE greatest(2, least(12, floor(k * 0.5e0))) END AS INTEGER) AS meshes,
  CAST(CASE p WHEN 'xr' THEN greatest(1, least(2, floor(k * 0.25e0))) WHEN 'mobile' THEN greatest(1, least(2, floor(k * 0.22e0))) ELSE greatest(1, least(6, floor(k * 0.25e0))) END AS INTEGER) AS textures, [180, 240, 360, 500, 800, 1200][i] AS tiles, CAST([256, 320, 512, 640, 1024, 1536][i] AS BIGINT) * 1048576 AS source_bytes, CAST([640, 896, 1280, 1536, 2048, 3072][i] AS BIGINT) * 1048576 AS gpu_bytes FROM t""")
def d14_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers and caps of devices."""
    meshes, textures, _ = devices.workers(F.col("profile"), F.col("cores"))
    caps = devices.resident_caps(F.col("profile"), F.col("cores"), F.col("memory"))
    return view(spark, sf_dir, _DEVICES).select("event_id", meshes.alias("meshes"), textures.alias("textures"), caps["tiles"].alias("tiles"), caps["source_bytes"].cast("long").alias("source_bytes"), caps["gpu_bytes"].cast("long").alias("gpu_bytes"))
