"""Queries over telemetry: stages, metrics, counters, gauges, averages, streaks and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import folds, quantiles
from .fixtures import FRAMES, epoch_ms, table, view
from .registry import query

_STAGE = "CASE event_type WHEN 'signup' THEN 'requested' WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'decoding' WHEN 'purchase' THEN 'visible' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(f"SELECT stage, count(*) AS nodes FROM (SELECT arg_max({_STAGE.replace('END', 'ELSE chr(0) END')}, (ts, event_id)) AS stage FROM events GROUP BY user_id) WHERE stage <> chr(0) GROUP BY stage")
def f1_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by their latest stage; a null stage takes the node out."""
    latest = _events(spark, sf_dir).groupBy("user_id").agg(F.max_by(F.struct(F.expr(_STAGE).alias("s")), F.struct("ts", "event_id")).alias("l"))
    return latest.select(F.col("l.s").alias("stage")).where("stage is not null").groupBy("stage").agg(F.count(F.lit(1)).alias("nodes"))


@query("""WITH a AS (SELECT event_type AS name, count(*) AS count, round(sum(value), 4) AS total, max(value) AS maximum, round(sum(value) / count(*), 6) AS average FROM events WHERE value >= 0 GROUP BY event_type),
r AS (SELECT event_type AS name, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value >= 0) WHERE k <= 256)
SELECT a.*, p50, p95, p99 FROM a JOIN (SELECT name, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM r GROUP BY name) USING (name)""")
def f6_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime totals, and nearest-rank percentiles of the last 256 samples."""
    good = _events(spark, sf_dir).where("value >= 0 and not isnan(value)")
    totals = good.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("maximum"), F.round(F.sum("value") / F.count(F.lit(1)), 6).alias("average"))
    last = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = good.withColumn("k", F.row_number().over(last)).where("k <= 256")
    ranks = recent.groupBy(F.col("event_type").alias("name")).agg(*[F.expr(f"percentile_disc({p}) within group (order by value)").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    return totals.join(ranks, "name")


@query("SELECT event_type AS name, sum(CAST(floor(value) AS BIGINT) - 20) AS counter, arg_max(value, (ts, event_id)) AS gauge, count(*) FILTER (WHERE value > 50) AS slow FROM events GROUP BY event_type")
def f4_counters_and_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that may fall, and the last value of gauges."""
    e = _events(spark, sf_dir)
    return e.groupBy(F.col("event_type").alias("name")).agg(F.sum(F.floor("value").cast("long") - 20).alias("counter"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"), F.count_if(F.col("value") > 50).alias("slow"))


@query("""SELECT user_id AS session_id, count(*) AS frames, round(avg(value), 6) AS average, max(value) AS maximum, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99,
  max(event_id) - min(event_id) AS delta, round(sum(value) / 1048576, 12) AS megabytes FROM events GROUP BY user_id""")
def f11_flight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, mean, maximum and percentiles of a flight, and what its counters moved by."""
    e = _events(spark, sf_dir).withColumnRenamed("user_id", "session_id")
    sums = e.groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("value"), 6).alias("average"), F.max("value").alias("maximum"), (F.max("event_id") - F.min("event_id")).alias("delta"), F.round(F.sum("value") / 1048576, 12).alias("megabytes"))
    return sums.join(quantiles.nearest_rank(e, ["session_id"], "value", {"p95": 0.95, "p99": 0.99}), "session_id")


def _piece():  # type: ignore[no-untyped-def]
    """Five minutes of event time: short enough for the busiest key's rows, long enough to leave few pieces."""
    return F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300)


def _reduced(start: str, step: str) -> str:
    """A fold in DuckDB: a and b are what was and what comes."""
    return f"list_reduce(list_prepend({start}, list(value ORDER BY ts, event_id)), lambda a, b: {step})"


@query(f"""SELECT user_id AS session_id, round({_reduced('16e0', '0.9 * a + 0.1 * greatest(b, 1)')}, 6) AS frame_time, round({_reduced('CAST(NULL AS DOUBLE)', 'coalesce(0.85 * a + 0.15 * b, b)')}, 6) AS frame_cost,
  round({_reduced('1e0', 'CASE WHEN b / 40 > 1.3 THEN least(10, a * 1.1) ELSE greatest(1, a * 0.98) END')}, 6) AS memory_bias, round({_reduced('1e0', 'CASE WHEN b / 16 > 1.5 THEN least(3, a * 1.05) WHEN b / 16 < 1.1 THEN greatest(1, a * 0.97) ELSE a END')}, 6) AS frame_bias FROM events GROUP BY user_id""")
def g1_moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving averages of frame time and cost, and the two error biases."""
    v = F.col("value")
    found = {
        "frame_time": folds.Average(F.greatest(v, F.lit(1.0)), 16.0, folds.ewma(0.9)), "frame_cost": folds.Average(v, None, folds.ewma(0.85)),
        "memory_bias": folds.Average(v / 40, 1.0, folds.memory_bias), "frame_bias": folds.Average(v / 16, 1.0, folds.frame_bias),
    }
    out = folds.averages(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], _piece(), found)
    return out.select(F.col("user_id").alias("session_id"), *[F.round(c, 6).alias(c) for c in found])


@query(f"SELECT user_id AS session_id, event_type AS phase, round({_reduced('CAST(NULL AS DOUBLE)', 'coalesce(0.8 * a + 0.2 * b, b)')}, 6) AS cost FROM events GROUP BY user_id, event_type")
def g3_phase_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moving average of each phase's cost."""
    found = {"cost": folds.Average(F.col("value"), None, folds.ewma(0.8))}
    out = folds.averages(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"], _piece(), found)
    return out.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("phase"), F.round("cost", 6).alias("cost"))


@query("""SELECT event_id, status, status IN (400, 401, 403) AS session_failure, status IN (404, 410, 422) AS absent, failures, CASE WHEN status IN (404, 410, 422) AND failures >= 3 THEN greatest(least(8000e0, 500 * pow(2, least(failures - 1, 10))), 30000) ELSE least(8000e0, 500 * pow(2, least(failures - 1, 10))) END AS delay_ms,
  count(*) OVER (ORDER BY epoch_ms(ts) RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW) >= 5 AS burst FROM (SELECT *, [400, 404, 410, 422, 500][event_id % 5 + 1] AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS failures FROM events WHERE event_type = 'error')""")
def g4_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of failures, backoff, and five within ten seconds.

    The log has no key to divide it by, so it is cut into stretches of ten minutes; a failure in the last ten seconds of one is
    counted in the next as well, and kept in its own only.
    """
    e = _events(spark, sf_dir).where("event_type = 'error'").withColumn("status", F.array(*map(F.lit, (400, 404, 410, 422, 500)))[(F.col("event_id") % 5).cast("int")])
    e = e.withColumn("failures", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    delay, absent = F.least(F.lit(8000.0), 500 * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(10)))), F.col("status").isin(404, 410, 422)
    e = e.withColumn("ms", epoch_ms(F.col("ts"))).withColumn("own", F.floor(F.col("ms") / 600000))
    e = e.withColumn("stretch", F.explode(F.sequence("own", F.floor((F.col("ms") + 10000) / 600000))))
    e = e.withColumn("recent", F.count(F.lit(1)).over(Window.partitionBy("stretch").orderBy("ms").rangeBetween(-10000, 0))).where("stretch = own")
    return e.select("event_id", "status", F.col("status").isin(400, 401, 403).alias("session_failure"), absent.alias("absent"), F.col("failures").cast("long").alias("failures"), F.when(absent & (F.col("failures") >= 3), F.greatest(delay, F.lit(30000.0))).otherwise(delay).alias("delay_ms"), (F.col("recent") >= 5).alias("burst"))


_SEEN = "event_type IN ('view', 'click')"


@query(f"""WITH f AS (SELECT * FROM ({FRAMES}) q), s AS (SELECT session_id, frame_no, frame_no - row_number() OVER (PARTITION BY session_id ORDER BY frame_no) AS island FROM f WHERE {_SEEN})
SELECT session_id, frame_no, min(frame_no) OVER (PARTITION BY session_id, island) AS since, frame_no - min(frame_no) OVER (PARTITION BY session_id, island) >= 2 AS settled FROM s""")
def g6_view_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Since when a tile has been in view without a gap, and whether for two frames."""
    f = view(spark, sf_dir, FRAMES).where(_SEEN)
    f = f.withColumn("island", F.col("frame_no") - F.row_number().over(Window.partitionBy("session_id").orderBy("frame_no")))
    f = f.withColumn("since", F.min("frame_no").over(Window.partitionBy("session_id", "island")))
    return f.select("session_id", "frame_no", "since", (F.col("frame_no") - F.col("since") >= 2).alias("settled"))


@query(f"""WITH f AS (SELECT *, {_SEEN} AS shown FROM ({FRAMES}) q), g AS (SELECT *, lag(shown) OVER w AS was, lead(shown) OVER w AS next_, last_value(CASE WHEN shown THEN frame_no END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_shown FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_no))
SELECT session_id, frame_no, CASE WHEN shown AND NOT coalesce(was, false) THEN 'shown' ELSE 'dropped' END AS change, shown AND last_shown IS NOT NULL AND frame_no - last_shown < 60 AS oscillates, NOT shown AND NOT coalesce(next_, false) AS hides, last_shown FROM g WHERE shown <> coalesce(was, false)""")
def g9_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a frame shows and drops, hides that re-selection cancels, oscillation."""
    w = Window.partitionBy("session_id").orderBy("frame_no")
    f = view(spark, sf_dir, FRAMES).withColumn("shown", F.expr(_SEEN))
    f = f.withColumns({"was": F.coalesce(F.lag("shown").over(w), F.lit(False)), "next": F.coalesce(F.lead("shown").over(w), F.lit(False)), "last_shown": F.last(F.when(F.col("shown"), F.col("frame_no")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return f.where("shown <> was").select("session_id", "frame_no", F.when(F.col("shown"), "shown").otherwise("dropped").alias("change"), (F.col("shown") & F.col("last_shown").isNotNull() & (F.col("frame_no") - F.col("last_shown") < 60)).alias("oscillates"), (~F.col("shown") & ~F.col("next")).alias("hides"), "last_shown")


@query("""SELECT session_id, frame_no, round(greatest(0e0, 16.67 - value - 2) * CASE WHEN event_type = 'view' THEN 0.45e0 ELSE 1e0 END, 6) AS headroom, least(1e0, frame_no / 30e0) AS progress, value * 10 > 350 AS aged FROM (""" + FRAMES + ") q")
def d15_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame headroom as a preparation budget, progress of a cross-fade, jobs that have aged."""
    f = view(spark, sf_dir, FRAMES)
    return f.select("session_id", "frame_no", F.round(F.greatest(F.lit(0.0), 16.67 - F.col("value") - 2) * F.when(F.col("event_type") == "view", 0.45).otherwise(1.0), 6).alias("headroom"), F.least(F.lit(1.0), F.col("frame_no") / 30.0).alias("progress"), (F.col("value") * 10 > 350).alias("aged"))
