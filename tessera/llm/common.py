"""What several corpus operators share: spooled tables, Arrow batch bounds, gapless numbering."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that a Python stage works on at once.  Spark's own Arrow batches are bounded by bytes; these are smaller.
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20
#: Rows of a bucket that ``gapless`` numbers in one go.
BUCKET_ROWS = 250
#: Keys that a hot join may broadcast: those with at least 1 / HOT_KEYS of all rows.
HOT_KEYS = 1000
#: Words of 64 bits of a sieve: a table of at most 16 MB, whatever it is made of.
SIEVE_WORDS = 1 << 20
#: The white space that text contracts name: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"

_spooled: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a plain local master, where all run in one process, may do without the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    made = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def spool(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, so a lost executor costs nothing
    that came before, and costly columns are computed once.  The files go when the interpreter ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-spool-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _spooled.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(some: list[tuple[SparkSession, str]]) -> None:
    for spark, path in some:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _discard() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        _delete(_spooled)


def spooled() -> int:
    """How many tables have been spooled."""
    return len(_spooled)


def release(since: int) -> None:
    """Deletes the tables spooled after the first ``since`` ones, but not the last.  Whoever calls this needs them no more."""
    _delete(_spooled[since:-1])
    del _spooled[since:-1]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, and of more than ``size`` bytes only where a single row has them."""
    for b in batches:
        each = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, max(1, b.num_rows), each):
            part = b.slice(at, each)
            if part.num_rows > 1 and part.nbytes > 4 * size:  # a few long rows among short ones
                yield from slices(iter([part]), part.num_rows // 2, size)
            else:
                yield part


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... within each value of ``keys`` (not null), each number once.

    ``rows`` is the count of the largest key.  Rows of a key are dealt by a hash of ``order``, which should tell them apart,
    into buckets of about BUCKET_ROWS, numbered inside the bucket and moved on by the rows of the buckets before, so no
    task holds a whole key.  ``df`` is read twice and must give the same rows both times.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # The buckets of a key are summed in two steps, so that a key with very many of them stays split as well.
    counts = counts.withColumn("_block", F.floor(F.col("_bucket") / 4096))
    blocks = counts.groupBy(*keys, "_block").agg(F.sum("_rows").alias("_all"))
    upto = Window.orderBy("_block").partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_all").over(upto), F.lit(0)).alias("_start"))
    before = Window.partitionBy(*keys, "_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(blocks, [*keys, "_block"])
    offsets = offsets.select(*keys, "_bucket", (F.col("_offset") + F.col("_start")).alias("_offset"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return ranked.join(offsets, [*keys, "_bucket"]).withColumn(out, (F.col("_offset") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_rank", "_offset")


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once and its number of rows as ``count``.

    Keys with at least 1 / HOT_KEYS of the ``total`` rows, so at most HOT_KEYS of them, are broadcast; their rows need no
    shuffle.  The others meet by a shuffle in which no key is large.  Both tables are read twice.
    """
    hot = F.col(count) * HOT_KEYS >= max(1, total)
    few = table.where(hot)
    cold = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.where(~hot), keys)
    return rows.join(F.broadcast(few), keys).unionByName(cold)


def sieved(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the ids, and those whose key surely isn't (null keys among these).

    The ids' hashes set bits in a table of SIEVE_WORDS words, which is broadcast: its size is bounded, and with very many ids it
    only lets more rows through.  So a join with the ids needs a shuffle of the first rows alone.  Both results read ``rows``."""

    def places(c: str) -> tuple[Column, Column]:
        h = F.xxhash64(c)
        return h.bitwiseAND(F.lit(SIEVE_WORDS - 1)).alias("_word"), F.shiftrightunsigned(h, 58).cast("int").alias("_bit")

    bits = ids.select(*places(id_col)).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = rows.select("*", *places(key)).join(F.broadcast(bits), "_word", "left")
    may = F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1L = 1L"), F.lit(False)) & F.col(key).isNotNull()
    return marked.where(may).select(*rows.columns), marked.where(~may).select(*rows.columns)


def utf8_bytes(text: Column) -> Column:
    """Bytes of a text; none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
