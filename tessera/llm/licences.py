"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Lines that hold a marker word are a file's headers; a licence file is also taken as a whole.  Equal segments are scored once.
Weights are term frequency times ``ln((1 + N) / (1 + df)) + 1``, where N and df count the segments of all files.  Only terms
of the templates need a document frequency, so that table is bounded; any other term of a segment has the weight of df = 0.
A file whose headers match no template takes the licence of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool

#: Least cosine of a match.
LEAST = 0.6
#: Lines with one of these words are headers.
MARKER = r"(?i)licen[sc]e|copyright|copyleft|spdx|public domain|redistribution|permission"
_WORD = "[a-z0-9]+"

# Fixed values: (licence, text of a notice or of a licence's first paragraph).
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _weights(segments: DataFrame, key: list[str], idf: DataFrame, unseen: Column) -> DataFrame:
    """Sparse rows (key, term, weight, norm-free) of segments with a column terms."""
    tf = segments.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(F.broadcast(idf), "term", "left").select(*key, "term", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))


def scan(files: DataFrame, path: Column, licence_file: Column, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Columns doc_id, path, licence, score, origin, from_id for every row of ``files``.

    origin: ``own`` (a header or the licence file's text matches), ``inherited`` (licence and score of the licence file named
    by from_id), or ``none`` (licence, score and from_id null).  Of a directory's licence files the one of the highest score,
    then the smallest id counts.  A null text has no headers; a null path stands for the root directory; rows with null ids
    are kept with origin ``none`` or ``inherited``.  Rows of one id share what is found for any of them.  Empty tables give
    empty results; other columns are ignored.
    """
    spark = files.sparkSession
    # A trailing slash names a directory itself; what follows the last slash is the file.
    rows = spool(
        files.select(
            F.col(id_col).alias("doc_id"), F.coalesce(path, F.lit("/")).alias("path"), F.coalesce(licence_file, F.lit(False)).alias("licence_file"),
            F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda line: line.rlike(MARKER)).alias("lines"),
            F.when(licence_file & F.col(text_col).rlike(MARKER), F.col(text_col)).alias("whole"),
        )
    )
    found = rows.select("doc_id", F.explode(F.concat("lines", F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.array().cast("array<string>")))).alias("segment"))
    found = found.where("doc_id is not null").select("doc_id", "segment", F.unhex(F.sha2("segment", 256)).alias("key"))
    segments = spool(found.groupBy("key").agg(F.any_value("segment").alias("segment"), F.count(F.lit(1)).alias("n")).select("key", _terms(F.col("segment")).alias("terms"), "n"))
    total = segments.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, licence string, text string").select("template", "licence", _terms(F.col("text")).alias("terms"))
    vocabulary = wanted.select(F.explode("terms").alias("term")).distinct()
    seen = segments.select("n", F.explode(F.array_distinct("terms")).alias("term")).join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1
    idf = spool(vocabulary.join(seen, "term", "left").select("term", weight.alias("idf")))
    unseen = F.log(F.lit(1.0 + total)) + 1
    of_template = _weights(wanted, ["template", "licence"], idf, unseen)
    size = of_template.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    of_template = spool(of_template.join(size, "template").select("template", "licence", "term", (F.col("w") / F.col("size")).alias("v")))
    of_segment = _weights(segments, ["key"], idf, unseen)
    norms = of_segment.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = of_segment.join(F.broadcast(of_template), "term").groupBy("key", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("size"), 6)
    best = dots.join(norms, "key").select("key", F.struct((-cosine).alias("minus"), "licence").alias("b")).groupBy("key").agg(F.min("b").alias("b")).where(F.col("b.minus") <= -least)
    own = spool(found.select("doc_id", "key").join(best, "key").groupBy("doc_id").agg(F.min("b").alias("own")))
    directory = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    placed = rows.select("doc_id", "path", "licence_file", F.when(directory == "", F.lit("/")).otherwise(directory).alias("dir")).join(own, "doc_id", "left")
    placed = spool(placed)
    given = placed.where("licence_file and own is not null").groupBy("dir").agg(F.min(F.struct("own", "doc_id")).alias("given")).select(F.col("dir").alias("above"), "given")
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/")))
    chain = placed.select("dir").distinct().select("dir", F.explode(above).alias("above"))
    nearest = chain.join(given, "above").groupBy("dir").agg(F.max_by("given", F.length("above")).alias("given"))
    out = placed.join(nearest, "dir", "left")
    mine, theirs = F.col("own").isNotNull(), F.col("given").isNotNull()
    return out.select(
        "doc_id", "path",
        F.when(mine, F.col("own.licence")).otherwise(F.col("given.own.licence")).alias("licence"),
        F.when(mine, -F.col("own.minus")).otherwise(-F.col("given.own.minus")).alias("score"),
        F.when(mine, "own").when(theirs, "inherited").otherwise("none").alias("origin"),
        F.when(mine, F.col("doc_id")).otherwise(F.col("given.doc_id")).alias("from_id"),
    )


def document_path() -> Column:
    """Documents have no paths; this gives them some.  Ids divisible by 100 stand in their source's folder, others one below."""
    source = F.coalesce("source", F.lit("unknown"))
    below = F.concat((F.col("doc_id") - F.pmod("doc_id", F.lit(200))).cast("string"), F.lit("/"))
    return F.concat(F.lit("/"), source, F.lit("/"), F.when(F.pmod("doc_id", F.lit(100)) == 0, F.lit("")).otherwise(below), F.col("doc_id").cast("string"))


def document_is_licence() -> Column:
    """Ids divisible by 10 stand for licence files."""
    return F.pmod("doc_id", F.lit(10)) == 0


def oracle_sql() -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
    marker = MARKER.removeprefix("(?i)")
    return f"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 10 = 0 AS licence_file,
  '/' || coalesce(source, 'unknown') || '/' || CASE WHEN doc_id % 100 = 0 THEN '' ELSE CAST(doc_id - doc_id % 200 AS VARCHAR) || '/' END AS dir FROM documents),
s AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{marker}', 'i'))) AS segment FROM f
  UNION ALL SELECT doc_id, text FROM f WHERE licence_file AND regexp_matches(text, '{marker}', 'i')),
d AS (SELECT segment, count(*) AS n, regexp_extract_all(lower(segment), '{_WORD}') AS terms FROM s GROUP BY segment),
t AS (SELECT template, licence, regexp_extract_all(lower(text), '{_WORD}') AS terms FROM (VALUES {quoted}) v(template, licence, text)),
vocabulary AS (SELECT DISTINCT unnest(terms) AS term FROM t),
seen AS (SELECT term, sum(n) AS df FROM (SELECT n, unnest(list_distinct(terms)) AS term FROM d) JOIN vocabulary USING (term) GROUP BY term),
total AS (SELECT coalesce(sum(n), 0) AS n FROM d),
idf AS (SELECT term, ln((1.0 + total.n) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocabulary LEFT JOIN seen USING (term), total),
tw AS (SELECT template, licence, term, count(*) * any_value(idf) AS w FROM (SELECT template, licence, unnest(terms) AS term FROM t) JOIN idf USING (term) GROUP BY ALL),
sw AS (SELECT segment, term, count(*) * coalesce(any_value(idf), any_value(ln(1.0 + total.n) + 1)) AS w FROM (SELECT segment, unnest(terms) AS term FROM d) LEFT JOIN idf USING (term), total GROUP BY segment, term),
dots AS (SELECT segment, template, licence, sum(sw.w * tw.w) AS dot FROM sw JOIN tw USING (term) GROUP BY ALL),
sn AS (SELECT segment, sqrt(sum(w * w)) AS size FROM sw GROUP BY segment), tn AS (SELECT template, sqrt(sum(w * w)) AS size FROM tw GROUP BY template),
c AS (SELECT segment, licence, round(dot / sn.size / tn.size, 6) AS score FROM dots JOIN sn USING (segment) JOIN tn USING (template)),
own AS (SELECT doc_id, first(licence ORDER BY score DESC, licence) AS licence, max(score) AS score FROM s JOIN c USING (segment) WHERE score >= {LEAST} GROUP BY doc_id),
given AS (SELECT dir, first(doc_id ORDER BY score DESC, licence, doc_id) AS from_id, first(licence ORDER BY score DESC, licence, doc_id) AS licence, max(score) AS score FROM f JOIN own USING (doc_id) WHERE licence_file GROUP BY dir),
near AS (SELECT a.dir, arg_max(g.from_id, length(g.dir)) AS from_id, arg_max(g.licence, length(g.dir)) AS licence, arg_max(g.score, length(g.dir)) AS score
  FROM (SELECT DISTINCT dir FROM f) a JOIN given g ON starts_with(a.dir, g.dir) GROUP BY a.dir)
SELECT f.doc_id, f.dir || CAST(f.doc_id AS VARCHAR) AS path, coalesce(own.licence, near.licence) AS licence, coalesce(own.score, near.score) AS score,
  CASE WHEN own.score IS NOT NULL THEN 'own' WHEN near.score IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.score IS NOT NULL THEN f.doc_id ELSE near.from_id END AS from_id
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near ON near.dir = f.dir
"""
