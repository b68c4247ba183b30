"""Queries over cache accesses: replay under a byte budget, freshness, hit rates, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cache
from ..operators.lineage import scratch
from ..sources import store
from .fixtures import ACCESSES, epoch_ms, view
from .registry import query

_SPAN = f"""WITH a AS (SELECT *, lag(seq) OVER w AS prev, coalesce(lead(seq) OVER w, 9000000000) AS next_ FROM ({ACCESSES}) q WINDOW w AS (PARTITION BY cache_id, key ORDER BY seq)),
s AS (SELECT a.cache_id, a.seq, a.key, a.size, a.prev, coalesce(sum(b.size), 0) AS between_ FROM a LEFT JOIN a b ON a.cache_id = b.cache_id AND b.seq > a.prev AND b.seq < a.seq AND b.next_ >= a.seq GROUP BY ALL)"""


@query(f"{_SPAN} SELECT cache_id, seq, key, prev, prev IS NOT NULL AND size + between_ <= 512 AS hit FROM s")
def k2_strict_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a least-recently-used cache of 512 bytes, in closed form."""
    return cache.lru_hits(view(spark, sf_dir, ACCESSES), 512)


@query(f"{_SPAN} SELECT cache_id, seq, key, prev, prev IS NOT NULL AND (size + between_ <= 40 OR prev = seq - 1) AS hit FROM s")
def k2_newest_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the newest entry is never its own victim, in 40 bytes."""
    return cache.lru_hits(view(spark, sf_dir, ACCESSES), 40, newest_stays=True)


@query(f"{_SPAN} SELECT cache_id, count(*) FILTER (WHERE prev IS NOT NULL AND size + between_ <= 512) AS hits, count(*) FILTER (WHERE NOT coalesce(size + between_ <= 512 AND prev IS NOT NULL, false)) AS misses, round(count(*) FILTER (WHERE prev IS NOT NULL AND size + between_ <= 512) / count(*)::DOUBLE, 6) AS hit_rate FROM s GROUP BY cache_id")
def f7_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and their rate."""
    hits = cache.lru_hits(view(spark, sf_dir, ACCESSES), 512)
    return hits.groupBy("cache_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("hit_rate"))


@query(f"""WITH m AS (SELECT cache_id, key, max(seq) AS last, max(size) AS size FROM ({ACCESSES}) q GROUP BY cache_id, key), r AS (SELECT *, sum(size) OVER (PARTITION BY cache_id ORDER BY last DESC) AS upto FROM m)
SELECT cache_id, key, CAST(upto AS BIGINT) AS upto, upto > 256 AS evicted, CAST(sum(size) OVER (PARTITION BY cache_id) AS BIGINT) AS total FROM r""")
def h11_persistent_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest first until what is left fits 256 bytes."""
    m = view(spark, sf_dir, ACCESSES).groupBy("cache_id", "key").agg(F.max("seq").alias("last"), F.max("size").alias("size"))
    w = Window.partitionBy("cache_id")
    return m.withColumn("upto", F.sum("size").over(w.orderBy(F.desc("last")).rowsBetween(Window.unboundedPreceding, 0))).select("cache_id", "key", "upto", (F.col("upto") > 256).alias("evicted"), F.sum("size").over(w).alias("total"))


_HEADER = "CASE event_id % 6 WHEN 0 THEN 'no-store' WHEN 1 THEN 'no-cache' WHEN 2 THEN 'max-age=60' WHEN 3 THEN 'private, max-age=14400, must-revalidate' END"
_NOW = 1_700_000_000_000


@query(f"""WITH h AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS age_s, {_HEADER} AS cc, CASE WHEN event_id % 6 = 4 THEN {_NOW} + 3600000 END AS expires FROM ({ACCESSES}) q),
e AS (SELECT *, try_cast(nullif(regexp_extract(coalesce(cc, ''), 'max-age=([0-9]+)', 1), '') AS BIGINT) AS max_age FROM h),
x AS (SELECT *, CASE WHEN cc = 'no-cache' THEN {_NOW} WHEN max_age IS NOT NULL THEN {_NOW} + greatest(0, max_age - age_s) * 1000 ELSE expires END AS own FROM e)
SELECT event_id, coalesce(cc <> 'no-store', true) AS cacheable, CASE WHEN cc = 'no-store' THEN NULL ELSE least(coalesce(own, {_NOW} + 10800000), {_NOW} + 10800000) END AS expires_at, coalesce(CASE WHEN cc = 'no-store' THEN NULL ELSE least(coalesce(own, {_NOW} + 10800000), {_NOW} + 10800000) END > {_NOW} + 30000, false) AS fresh FROM x""")
def d17_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a response expires by its headers and the policy's three hours, and whether it is fresh."""
    a = view(spark, sf_dir, ACCESSES).select("event_id", F.floor("value").cast("long").alias("age_s"), F.expr(_HEADER).alias("cache_control"), F.when(F.col("event_id") % 6 == 4, F.lit(_NOW + 3_600_000)).alias("expires"))
    cacheable, at = cache.freshness(F.col("cache_control"), F.col("age_s"), F.col("expires"), F.lit(_NOW), 10_800_000)
    return a.select("event_id", cacheable.alias("cacheable"), at.alias("expires_at")).withColumn("fresh", F.coalesce(F.col("expires_at") > _NOW + 30_000, F.lit(False)))


@query(f"""WITH a AS (SELECT *, epoch_ms(ts) AS t0, epoch_ms(ts) + CAST(floor(value * 100) AS BIGINT) AS t1 FROM ({ACCESSES}) q), b AS (SELECT *, max(t1) OVER (PARTITION BY key ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM a)
SELECT event_id, key, coalesce(t0 < busy, false) AS shared, sum(CASE WHEN t0 < busy THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS fetch FROM b""")
def k3_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: requests for a key while it is being fetched share the fetch."""
    at = epoch_ms(F.col("ts"))
    return cache.coalesced(view(spark, sf_dir, ACCESSES).select("event_id", "key", at.alias("t0"), (at + F.floor(F.col("value") * 100).cast("long")).alias("t1")))


_PUTS = "SELECT 'k' || (event_id * 7 % 397) AS key, event_id AS written_at, event_id % 90 + 1 AS size FROM events"
_MOST = 9000


def _kept_sql(source: str) -> str:
    return f"SELECT key, written_at, size FROM (SELECT *, sum(size) OVER (ORDER BY written_at DESC, key) AS upto FROM ({source}) q) WHERE upto <= {_MOST}"


@query(f"""WITH p AS ({_PUTS}), b AS MATERIALIZED (SELECT key, written_at % 2 AS part, max(written_at) AS written_at, arg_max(size, written_at) AS size FROM p GROUP BY ALL), one AS ({_kept_sql('SELECT key, written_at, size FROM b WHERE part = 0')}),
two AS ({_kept_sql('SELECT key, written_at, size FROM b WHERE part = 1 UNION ALL SELECT * FROM one WHERE key NOT IN (SELECT key FROM b WHERE part = 1)')}) SELECT key, written_at, CAST(size AS BIGINT) AS size, CAST(size AS BIGINT) AS n_bytes FROM two""")
def s1_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches put into a store of bytes, and what it holds after evictions."""
    folder = scratch(spark, "store")
    rows = view(spark, sf_dir, _PUTS).select("key", "written_at", F.repeat(F.lit("x"), F.col("size").cast("int")).cast("binary").alias("content"), F.lit(None).alias("expires_at"), F.lit(None).alias("etag"))
    for batch in (0, 1):
        store.put(rows.where(F.col("written_at") % 2 == batch), folder, batch, _MOST)
    return store.read(spark, folder).select("key", "written_at", "size", F.length("content").cast("long").alias("n_bytes"))
