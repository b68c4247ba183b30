"""A corpus pipeline: language, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; docs is a table read from files with the
columns of ``documents``.  Rows are told apart by their place in it, so rows of a null or repeated id are judged one by one.
Nulls in other columns are kept as they are, other columns are left out, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, exact_dedup, langid, packing, simhash, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a key for each row, the same whenever these files are read, that is ordered by id (null last), then place."""
    place = F.monotonically_increasing_id()
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", place.alias("place")).alias("key"))


def _without(rows: DataFrame, gone: DataFrame, since: int) -> DataFrame:
    """The rows whose key is no id of the ones that are gone; what was spooled to find these, after the first ``since``, is deleted."""
    places = common.spool(gone.select(F.col("doc_id.place").alias("place")))
    common.release(since)
    some, others = common.sieved(rows.withColumn("place", F.col("key.place")), "place", places, "place")
    return others.unionByName(some.join(places, "place", "left_anti")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; those without a letter or of no learned language go.

    The model is learned from the labelled documents; without any, all go.  Each row is judged by its text alone.
    """
    return langid.identify(docs, langid.fit(docs), carry=COLUMNS).where("not rejected").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: most code points, then smallest id, then place.

    Null and empty texts are one group.
    """
    rows, since = _numbered(docs), common.spooled()
    return _without(rows, exact_dedup.exact_duplicates(rows, id_col="key").where("not kept"), since)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, five-word shingles of Jaccard similarity 0.8 or more: smallest id, then place.

    Candidates come from SimHash deletion variants.  Null texts count as empty; a text of fewer words is one shingle.
    """
    rows, since = _numbered(docs), common.spooled()
    return _without(rows, simhash.similar_documents(rows, id_col="key").where("doc_id <> component_id"), since)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages of 100 bytes or more that occur earlier.  Bytes of characters cut in two go as well.

    Earlier is a smaller id (null first), or the same text further up; rows of one id are texts of their own.  Null texts stay null.
    """
    given = docs.select(*COLUMNS, F.col("text").isNull().alias("none"))
    found = suffix_dedup.remove_repeats(given, carry=("lang", "source", "none"))
    text = F.when(~F.col("none"), F.col("kept_text")).alias("text")
    return found.select("doc_id", text, "lang", "source").withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in bins of the permitted lengths.  A document's tokens are those of byte-level BPE, and one for its end.

    Null texts have the end only.
    """
    sized = bpe.encode_texts(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_tokens")
    return packing.pack(sized, length=F.col("n_tokens") + 1)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is written to the shared folder before the next, and what it
    needed for that is deleted."""
    since = common.spooled()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.spool(docs)
            common.release(since)
    return docs
