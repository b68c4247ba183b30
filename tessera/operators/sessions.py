"""Session tokens of a provider: which one each request carries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: Longest that what a session gave may be kept, in milliseconds.
MAX_AGE_MS = 10_800_000


def requests(log: DataFrame, source: str = "source_id") -> DataFrame:
    """Columns source, seq, session, request_url, cache_key, cacheable and max_age_ms for a log of (source, seq, url, given, root).

    ``given`` is a token set from then on, unless null or empty; before any is set, the first token seen in a URL is adopted.
    Root requests go out without a token, aren't cached and adopt nothing.  Rows without a source form one source.
    """
    w = Window.partitionBy(source).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    given = F.last(F.when(F.col("given") != "", F.col("given")), True).over(w)
    adopted = F.first(F.when(~F.col("root"), urls.parameter(F.col("url"), "session")), True).over(w)
    held = log.withColumn("session", F.coalesce(given, adopted))
    bare = F.regexp_replace(F.regexp_replace(F.col("url"), r"([?&])session=[^&#]*", "$1"), r"[?&]+(#|$)", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, "&{2,}", "&"), r"\?&+", "?")
    url = F.when(F.col("root"), bare).otherwise(urls.with_parameter(F.col("url"), "session", F.col("session")))
    return held.select(
        source, "seq", F.when(~F.col("root"), F.col("session")).alias("session"), url.alias("request_url"),
        F.when(~F.col("root"), urls.cache_key(url)).alias("cache_key"), (~F.col("root")).alias("cacheable"), F.when(~F.col("root"), F.lit(MAX_AGE_MS)).alias("max_age_ms"),
    )


def first_in_tree(tree: DataFrame, order: str = "path") -> DataFrame:
    """One row with the first token in the URLs of a flattened tree, in its order; null if there is none."""
    token = urls.parameter(F.col("url"), "session")
    return tree.select(token.alias("session"), order).agg(F.min_by("session", F.when(F.col("session").isNotNull(), F.col(order))).alias("session"))
