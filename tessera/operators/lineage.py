"""Cutting lineage in level-by-level walks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a plain local master may do without the setting; it gets a folder of its own.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="tessera-"))
    return jsc.getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """The table as written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the session's process ends."""
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
