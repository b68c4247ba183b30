"""A persistent store of bytes: contents and their metadata as two Parquet tables in one folder, written batch by batch.

``put`` may be run again for the same batch, so a stream's ``foreachBatch`` can call it: a batch overwrites its own files.
The metadata of a batch is written last, and contents without metadata are not seen, so a batch that failed half-way is
as if it had not been.  Batches are numbered upwards, one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

META = "key STRING, written_at LONG, size LONG, expires_at LONG, etag STRING, batch LONG"
CONTENT = "key STRING, content BINARY, batch LONG"


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def metadata(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """One row for each key that is held: that of its last batch, or of its last one below ``before``.

    Evicted keys and a store that isn't there give none.
    """
    if not _there(spark, f"{folder}/meta"):
        return spark.createDataFrame([], META)
    rows = spark.read.schema(META).parquet(f"{folder}/meta")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), "batch").alias("m")).select("key", "m.*")
    return last.where("size >= 0")  # an eviction is a row of size -1


def put(rows: DataFrame, folder: str, batch: int, most_bytes: int, quota: int | None = None) -> None:
    """Stores rows of (key, content, written_at, expires_at, etag); of rows with the same key the last written stays, then the largest.

    Where all would fill over nine tenths of the quota, the oldest go until four fifths are left; where they exceed ``most_bytes``,
    until they fit it.  Rows without a key are passed over; null content is empty.  Other columns are ignored.
    """
    spark = rows.sparkSession
    clean = rows.where("key is not null").select("key", F.coalesce("content", F.lit(b"")).alias("content"), F.col("written_at").cast("long").alias("written_at"), F.col("expires_at").cast("long").alias("expires_at"), F.col("etag").cast("string").alias("etag"))
    best = clean.groupBy("key").agg(F.max_by(F.struct("content", "written_at", "expires_at", "etag"), F.struct("written_at", F.length("content"), "content")).alias("r")).select("key", "r.*")
    best.select("key", "content").write.mode("overwrite").parquet(f"{folder}/content/batch={batch}")
    mine = best.select("key", "written_at", F.length("content").cast("long").alias("size"), "expires_at", "etag")
    held = metadata(spark, folder, batch)  # as it was before this batch, also when that is run again
    every = held.drop("batch").join(mine.select("key"), "key", "left_anti").unionByName(mine)
    total = every.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    most = min(most_bytes, int(quota * 0.8)) if quota and total > quota * 0.9 else most_bytes
    if total > most:
        gone = oldest_beyond(every, most)
        kept = mine.join(gone.select("key"), "key", "left_anti")
        mine = kept.unionByName(gone.withColumn("size", F.lit(-1).cast("long")))
    mine.write.mode("overwrite").parquet(f"{folder}/meta/batch={batch}")


def oldest_beyond(rows: DataFrame, most: int, width: int = 3_600_000) -> DataFrame:
    """The oldest rows of (key, written_at, size) that must go for the rest to fit ``most`` bytes; ties by key.

    Sizes are summed by hour first, so that only the hour in which the limit falls is put in order row by row.
    """
    hours = rows.withColumn("hour", F.floor(F.coalesce("written_at", F.lit(0)) / width))
    sums = hours.groupBy("hour").agg(F.sum("size").alias("n"))
    later = sums.withColumn("from_newest", F.sum("n").over(Window.orderBy(F.desc("hour"))))  # as many rows as hours
    edge = later.where(F.col("from_newest") > most).agg(F.max("hour").alias("hour")).first()["hour"]
    if edge is None:
        return rows.limit(0)
    newer = sums.where(F.col("hour") > edge).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    inside = hours.where(F.col("hour") == edge).withColumn("upto", F.sum("size").over(Window.partitionBy("hour").orderBy(F.desc("written_at"), "key").rowsBetween(Window.unboundedPreceding, 0)))
    return hours.where(F.col("hour") < edge).drop("hour").unionByName(inside.where(F.col("upto") + newer > most).drop("hour", "upto"))


def read(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, content, metadata) of what is held, of the given keys only if there are any."""
    held = metadata(spark, folder)
    held = held if keys is None else held.join(keys.select("key").distinct(), "key", "left_semi")
    if not _there(spark, f"{folder}/content"):
        return held.withColumn("content", F.lit(None).cast("binary"))
    return held.join(spark.read.schema(CONTENT).parquet(f"{folder}/content"), ["key", "batch"])
