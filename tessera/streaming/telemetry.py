"""Telemetry of a stream: windowed metrics, late events bounded by a watermark, and sinks that are safe to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and maximum of each metric in each window of event time; events later than ``late`` are left out.

    Event-time windows are an addition of this library: its snapshots otherwise cover a whole life.
    """
    good = stream.where("value >= 0 and not isnan(value)").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = good.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("name"))
    out = found.agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("total"), F.max("value").alias("maximum"))
    return out.select(F.col("w.start").alias("start"), "name", "count", "total", "maximum")


def drain(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Runs a stream over all that is there now, and reads what each micro-batch gave, with its ``batch_id``.

    A micro-batch overwrites its own folder under ``path``, so one that is run again after a failure counts once.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(f"{path}/out")


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key from what ``drain`` read in update mode."""
    rest = [c for c in batches.columns if c not in (*keys, "batch_id")]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("s")).select(*keys, "s.*")
