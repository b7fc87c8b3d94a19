"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's header blocks and its whole text are compared with full licence texts and usual headers
(``license_texts``); an SPDX identifier speaks for itself. For files in which these find nothing, their statements
speak: lines about licensing, wherever they stand. Each is a sparse vector of term counts
times inverse document frequencies over all statements, and is compared with the templates. Files without a licence of their own take
that of the licence file in the nearest directory above them, found by joins on paths.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, join_by_frequency, python_on_executors, table
from tidemark.llm.license_texts import SIGN, Texts

# Short notices of licences, in the order in which ties are decided.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
#: A line with one of these is a statement.
CUE = r"(?i)licen[cs]e|copyright|spdx|rights reserved|redistribution and use"
TERM = r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*"
#: Least similarity for a licence to be given.
LEAST = 0.6
#: Names of files that speak for their directory.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def statements(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line): the distinct statements of each file."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    has = files.select(F.col(f"`{key}`").alias("key"), body.alias("body")).filter(F.col("body").rlike(CUE))
    lines = F.array_distinct(F.filter(F.split("body", r"\r\n|\r|\n"), lambda x: x.rlike(CUE)))
    return has.select("key", F.explode(lines).alias("line"))


def blocks(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, license, similarity) of the files whose header or whole text is like a full licence text or a usual header, or that declare an SPDX identifier."""
    spark = files.sparkSession
    python_on_executors(spark)
    rows = files.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("body")).filter(F.col("body").rlike(SIGN))
    schema = rows.select("key").schema.add("license", "string").add("similarity", "double")
    held = spark.sparkContext.broadcast(Texts())

    def run(batches):
        for batch in batches:
            found = [(i, b) for i, x in enumerate(batch.column(1).to_pylist()) if (b := held.value.best(x))]
            if found:
                columns = [pa.array([b[0] for _, b in found], pa.string()), pa.array([b[1] for _, b in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found])), *columns], schema.names)

    return rows.mapInArrow(run, schema)


def matched(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, license, similarity): what a file's blocks say, else the template that fits its statements best, if any is similar enough.

    Equal lines are compared once, so a notice that a large part of all files has costs one comparison.
    """
    spark = files.sparkSession
    found = checkpointed(statements(files, key, text))
    lines = checkpointed(found.groupBy("line").agg(F.count("*").alias("n")))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    counted = lines.select("line", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(F.count("*").alias("tf"))
    df = counted.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("lines"))
    own = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(TEMPLATES)], "template int, license string, notice string")
    notices = own.select("template", "license", F.explode(terms(F.col("notice"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    n = int(total.first()["total"])
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.coalesce(F.col("df"), F.lit(0)))) + 1.0
    stats = checkpointed(df.select("term", "df", "lines"))
    weighed = join_by_frequency(counted, stats, "term", "lines", max(1, lines.count())).withColumn("w", F.col("tf") * idf)
    weighed = checkpointed(weighed.select("line", "term", "w"))
    # the templates are few and fixed
    of_notices = checkpointed(notices.join(stats, "term", "left").withColumn("v", F.col("tf") * idf).select("template", "license", "term", "v"))
    line_norm = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("line_norm"))
    notice_norm = of_notices.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("notice_norm"))
    dots = weighed.join(F.broadcast(of_notices), "term").groupBy("line", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosines = dots.join(F.broadcast(notice_norm), "template").join(line_norm, "line").select("line", "template", "license", F.round(F.col("dot") / (F.col("line_norm") * F.col("notice_norm")), 6).alias("cosine"))
    best = cosines.filter(F.col("cosine") >= LEAST).groupBy("line").agg(F.max(F.struct("cosine", (-F.col("template")).alias("rank"), "license")).alias("b"))
    best = checkpointed(best.join(lines, "line").select("line", "n", "b"))
    hits = join_by_frequency(found, best, "line", "n", max(1, n)).filter("b is not null")
    said = hits.select("key", F.struct(F.lit(0).alias("whole"), "b.cosine", "b.rank", "b.license").alias("b"))
    whole = blocks(files, key, text).select("key", F.struct(F.lit(1).alias("whole"), F.col("similarity").alias("cosine"), F.lit(0).alias("rank"), "license").alias("b"))
    return said.unionByName(whole).groupBy("key").agg(F.max("b").alias("b")).select("key", F.col("b.license").alias("license"), F.col("b.cosine").alias("similarity"))


def directory(path: Column) -> Column:
    """What stands before the last slash; a file without one lies in the root, the empty path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licenses(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(key, path, own_license, similarity, license, license_dir) of each file.

    own_license is what the file says itself (null: nothing similar enough), license that or
    the one inherited, license_dir the directory it is inherited from. Among several
    licence files of one directory the most similar speaks, then the first by path. A null
    path lies nowhere and inherits nothing; null and empty texts say nothing. Rows
    that repeat a key share what any of them says. Other columns are left out.
    """
    rows = files.select(F.col(f"`{key}`").alias("key"), F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{text}`").cast("string").alias("text"))
    own = matched(rows, "key", "text")
    said = checkpointed(rows.select("key", "path").join(own, "key", "left"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    speakers = said.filter(F.col("license").isNotNull() & name.rlike(LICENSE_FILE))
    dirs = checkpointed(speakers.groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("b")).select("dir", F.col("b.license").alias("dir_license")))
    silent = said.filter(F.col("license").isNull() & F.col("path").isNotNull()).select("key", "path")
    parts = F.split(directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, 1, k)))
    asked = silent.select("key", "path", F.explode(F.array_distinct(above)).alias("dir"))
    counts = checkpointed(asked.groupBy("dir").agg(F.count("*").alias("n")).join(dirs, "dir"))
    near = join_by_frequency(asked, counts, "dir", "n", max(1, said.count())).filter("dir_license is not null")
    taken = near.groupBy("key", "path").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "dir_license")).alias("t"))
    out = said.join(taken.select(F.col("key").alias("k2"), F.col("path").alias("p2"), "t"), F.col("key").eqNullSafe(F.col("k2")) & F.col("path").eqNullSafe(F.col("p2")), "left")
    return out.select(F.col("key").alias(key), F.col("path"), F.col("license").alias("own_license"), "similarity", F.coalesce("license", "t.dir_license").alias("license"), F.col("t.dir").alias("license_dir"))


def document_path(id_: Column) -> Column:
    """The tables name no files. Document n lies in top/mid/low of its thousands, hundreds and tens; every tenth is a licence file, of the highest directory whose first document it is."""
    s = lambda k: F.floor(id_ / k).cast("long").cast("string")
    top, mid, low = s(1000), s(100), s(10)
    return F.when(id_ % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(id_ % 100 == 0, F.concat_ws("/", top, mid, F.lit("LICENSE"))).when(id_ % 10 == 0, F.concat_ws("/", top, mid, low, F.lit("LICENSE"))).otherwise(F.concat_ws("/", top, mid, low, F.concat(id_.cast("string"), F.lit(".txt"))))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, own or inherited."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", document_path(F.col("doc_id")).alias("path"))
    return scan_licenses(docs)


_VALUES = ", ".join("({}, '{}', '{}')".format(i, k, v) for i, (k, v) in enumerate(TEMPLATES))
_DIR = "regexp_replace(path, '/[^/]*$', '')"
OP8_SQL = rf"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, CASE
    WHEN doc_id % 1000 = 0 THEN (doc_id // 1000)::VARCHAR || '/LICENSE'
    WHEN doc_id % 100 = 0 THEN (doc_id // 1000)::VARCHAR || '/' || (doc_id // 100)::VARCHAR || '/LICENSE'
    WHEN doc_id % 10 = 0 THEN (doc_id // 1000)::VARCHAR || '/' || (doc_id // 100)::VARCHAR || '/' || (doc_id // 10)::VARCHAR || '/LICENSE'
    ELSE (doc_id // 1000)::VARCHAR || '/' || (doc_id // 100)::VARCHAR || '/' || (doc_id // 10)::VARCHAR || '/' || doc_id::VARCHAR || '.txt' END AS path
  FROM documents),
a AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM f),
st AS (SELECT DISTINCT doc_id, line FROM a WHERE regexp_matches(line, '{CUE}')),
x AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM st),
tf AS (SELECT doc_id, line, term, count(*) AS tf FROM x GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM st),
tm(template, license, notice) AS (VALUES {_VALUES}),
tx AS (SELECT template, license, unnest(regexp_extract_all(lower(notice), '{TERM}')) AS term FROM tm),
tt AS (SELECT template, license, term, count(*) AS tf FROM tx GROUP BY ALL),
tv AS (SELECT template, license, tt.term, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0) AS v FROM tt LEFT JOIN d ON d.term = tt.term, n),
lv AS (SELECT doc_id, line, tf.term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN d ON d.term = tf.term, n),
tn AS (SELECT template, sqrt(sum(v * v)) AS tn FROM tv GROUP BY template),
nl AS (SELECT doc_id, line, sqrt(sum(w * w)) AS nl FROM lv GROUP BY ALL),
dot AS (SELECT doc_id, line, template, license, sum(w * v) AS dot FROM lv JOIN tv ON lv.term = tv.term GROUP BY ALL),
c AS (SELECT dot.doc_id, dot.template, license, round(dot / (nl * tn), 6) AS cosine FROM dot JOIN nl ON nl.doc_id = dot.doc_id AND nl.line = dot.line JOIN tn ON tn.template = dot.template),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, template, license DESC) AS k FROM c WHERE cosine >= {LEAST}),
o AS (SELECT f.doc_id, path, license AS own_license, cosine AS similarity FROM f LEFT JOIN r ON r.doc_id = f.doc_id AND k = 1),
s AS (SELECT {_DIR} AS dir, own_license FROM o WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE'),
i AS (SELECT o.doc_id, s.dir, s.own_license, row_number() OVER (PARTITION BY o.doc_id ORDER BY length(s.dir) DESC) AS k
  FROM o JOIN s ON o.own_license IS NULL AND starts_with({_DIR.replace('path', 'o.path')} || '/', s.dir || '/'))
SELECT o.doc_id, o.path, o.own_license, o.similarity, coalesce(o.own_license, i.own_license) AS license, CASE WHEN o.own_license IS NULL THEN i.dir END AS license_dir
FROM o LEFT JOIN i ON i.doc_id = o.doc_id AND i.k = 1
"""
QUERIES = {"op8_licenses": op8_licenses}
ORACLES = {"op8_licenses": OP8_SQL}
