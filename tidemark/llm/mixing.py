"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Each source gets a target of words by water-filling. A document's expected number
of copies is its inclusion weight times a factor of its source, MOST at the most; the factor is raised until
the expected words meet the target. The whole part
is allocated for certain; the rest is an inclusion probability. Within a source
documents are ranked by random odds divided by inclusion odds (Pareto order
sampling) and the leading ones are taken, as many as fill the words left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, checkpointed, table, unit_interval

#: A source's target, and a document's copies, stop at so many times its size.
MOST = 3
#: The ranking is cut in two steps of so many steps each: the last group to be put in order holds about a millionth of a source.
STEPS = 1024


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Targets for a table (source, source_size) with a row per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words.
    No target is above MOST times its source: what is above goes to the others
    by weight until none is above. This is water-filling: sources in order of
    cap over weight are capped while the level left for the rest is above theirs.
    """
    at = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("w", ((F.row_number().over(at) - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = w.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    free = F.col("level") <= F.col("cap") / F.col("w")
    # the levels fall from the first source that stays below its cap on
    flat = F.max(F.when(free, F.col("level"))).over(every)
    return level.withColumn("flat", flat).select("source", "source_size", F.when(F.col("cap") <= F.col("flat") * F.col("w"), F.col("cap")).otherwise(F.col("flat") * F.col("w")).alias("target"))


def inclusion(size: Column) -> Column:
    """Relative inclusion weights that fall with the root of the size, so that a few very long documents do not carry a source; 0 for documents without words."""
    return F.when(size > 0, F.floor(F.lit(1024.0) / F.sqrt(size)) + 1).otherwise(0).cast("long")


def factors(steps: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, target, factor): expected copies are least(MOST, weight * factor), and their words meet the target.

    ``steps`` has the words of each (source, weight). Weights at the cap leave the sum, which raises the factor of
    the others, until none is new at the cap. Where all are at the cap, or no weight is positive, the target is not met.
    """
    steps = steps.filter(F.col("weight") > 0)
    none = steps.groupBy("source").agg(F.sum(F.col("weight") * F.col("words")).alias("free")).withColumnRenamed("source", "of")
    now = goals.join(none, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "target", F.when(F.col("free") > 0, F.col("target") / F.col("free")).otherwise(0.0).alias("factor"))
    now = checkpointed(now)
    while True:
        held = now.withColumnsRenamed({"source": "of"})
        capped = F.col("weight") * F.col("factor") >= MOST
        sums = steps.join(F.broadcast(held) if few(now) else held, F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(F.sum(F.when(capped, F.col("words"))).alias("full"), F.sum(F.when(~capped, F.col("weight") * F.col("words"))).alias("free"))
        joined = now.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        raised = (F.col("target") - MOST * F.coalesce("full", F.lit(0))) / F.col("free")
        after = checkpointed(joined.select("source", "target", F.when((F.col("full") > 0) & (F.col("free") > 0), raised).otherwise(F.col("factor")).alias("factor"), F.col("factor").alias("was")))
        if after.filter("factor > was").isEmpty():
            return after.drop("was")
        now = after.drop("was")


def pareto_mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weight: str | None = None) -> DataFrame:
    """Whole copies and chosen remainders of each row.

    Returns the input with source_size, target, copies and taken (copies times
    size), which replace columns of these names. ``weight`` names a column of relative inclusion weights within a source
    (null or not positive: never taken; none: all equal);
    copies never exceed MOST. A source of no words takes nothing. Equal keys
    draw equal random numbers, rows without a key by their columns; ties go by key, size and a hash of all columns, and rows equal in all
    of these may be exchanged without changing the result. Every draw comes from
    the key, so reruns agree. Sources are few beside the rows: one task puts them in order.
    """
    kept = [c for c in df.columns if c not in ("source_size", "target", "copies", "taken")]
    names = {c: f"column_{i}" for i, c in enumerate(df.columns)}
    base = df.toDF(*names.values())
    x = F.greatest(F.coalesce(F.col(names[weight]), F.lit(0)), F.lit(0)) if weight else F.lit(1)
    key, source, size = names[key], names[source], names[size]
    whole_row = F.xxhash64(*base.columns)
    by = base.withColumns({"x": x, "row": whole_row, "salt": F.monotonically_increasing_id() % 4096})
    steps = checkpointed(by.groupBy(F.col(source).alias("source"), F.col("x").alias("weight")).agg(F.sum(size).alias("words")))
    sizes = checkpointed(steps.groupBy("source").agg(F.sum("words").alias("source_size")))
    goals = checkpointed(targets(sizes))
    found = factors(steps, goals.select("source", "target")).select(F.col("source").alias("of"), "factor")
    goals = checkpointed(goals.join(found, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("source", "s"))
    small = few(goals)
    placed = by.join(F.broadcast(goals) if small else goals, F.col(source).eqNullSafe(F.col("s")), "left")
    want = F.least(F.lit(float(MOST)), F.col("x") * F.col("factor"))
    draw = F.coalesce(F.col(key).cast("string"), F.col("row").cast("string"))
    u = unit_interval(F.lit("pareto"), draw)
    placed = placed.withColumn("want", want).withColumn("whole", F.floor("want")).withColumn("p", F.col("want") - F.col("whole"))
    placed = placed.withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    scaled = F.col("q") / (1 + F.col("q")) * STEPS
    placed = placed.withColumn("b", F.floor(scaled).cast("int")).withColumn("c", F.floor((scaled - F.floor(scaled)) * STEPS).cast("int"))
    placed = checkpointed(placed)

    open_ = placed.filter(F.col("q").isNotNull())
    words = open_.groupBy("s", "b").agg(F.sum(size).alias("n"))
    left = placed.groupBy("s").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col(size)).alias("sure")).select("s", (F.col("target") - F.col("sure")).alias("left"))
    edge = cut(words, left, "b")
    fine = open_.join(F.broadcast(edge) if small else edge, same("s") & (F.col("b") == F.col("edge_b")), "inner").drop("e_s")
    steps_c = fine.groupBy("s", "c").agg(F.sum(size).alias("n"))
    edge2 = cut(steps_c, edge.select(F.col("e_s").alias("s"), (F.col("left") - F.col("before")).alias("left")), "c")
    last = fine.drop("left", "before", "edge_b").join(F.broadcast(edge2) if small else edge2, same("s") & (F.col("c") == F.col("edge_c")), "inner").drop("e_s")
    # rows that repeat a key tie: cells of such rows are put in order, and only the cell in which the words end is numbered
    order = ("q", "key", "size", "row", "salt")
    cells = last.groupBy("s", "b", "c", "q", F.col(key).alias("key"), F.col(size).alias("size"), "row", "salt").agg(F.count("*").alias("m"), F.first("left").alias("left"), F.first("before").alias("before"))
    run = W.partitionBy("s", "c").orderBy(*order)
    cells = cells.withColumn("ahead", F.col("before") + F.sum(F.col("m") * F.col("size")).over(run.rowsBetween(W.unboundedPreceding, 0)) - F.col("m") * F.col("size"))
    # a row is taken if that brings the sum of the words nearer to what is left
    takes = F.when(F.col("ahead") * 2 + F.col("size") <= F.col("left") * 2, F.when(F.col("size") > 0, F.least(F.col("m"), F.floor((F.col("left") * 2 - F.col("ahead") * 2 + F.col("size")) / (F.col("size") * 2)))).otherwise(F.col("m"))).otherwise(0)
    line = cells.withColumn("takes", takes).filter("takes > 0").groupBy("s", "b", "c").agg(F.max(F.struct(*order, "takes", "m")).alias("line"))
    # every source with open rows has its cut here; without a line, nothing of the cut group is taken
    ends = checkpointed(last.select("s", "b", "c").distinct().join(line.withColumnsRenamed({"s": "e_s", "b": "e_b", "c": "e_c"}), same("s"), "left").select(F.col("s").alias("e_s"), F.col("b").alias("eb"), F.col("c").alias("ec"), "line"))
    joined = placed.join(F.broadcast(ends) if small else ends, same("s"), "left")
    here, there = F.struct("q", F.col(key).alias("key"), F.col(size).alias("size"), "row", "salt"), F.struct(*[F.col(f"line.{c}").alias(c) for c in order])
    in_cut = (F.col("b") == F.col("eb")) & (F.col("c") == F.col("ec"))
    ahead = (F.col("b") < F.col("eb")) | ((F.col("b") == F.col("eb")) & (F.col("c") < F.col("ec"))) | (in_cut & F.col("line").isNotNull() & (here < there))
    on_line = F.coalesce(F.col("q").isNotNull() & in_cut & F.col("line").isNotNull() & (here == there), F.lit(False))
    copies = lambda more: (F.col("whole") + F.coalesce(F.col("q").isNotNull() & more, F.lit(False)).cast("long")).cast("long")
    split = on_line & (F.col("line.takes") < F.col("line.m"))
    plain = joined.filter(~split).withColumn("copies", copies(ahead | on_line))
    numbered = joined.filter(split).withColumn("k", F.row_number().over(W.partitionBy("s").orderBy("salt")))
    edge_rows = numbered.withColumn("copies", copies(F.col("k") <= F.col("line.takes"))).drop("k")
    out = plain.unionByName(edge_rows)
    return out.select(*[F.col(names[c]).alias(c) for c in kept], F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col(size)).alias("taken"))


def few(goals: DataFrame) -> bool:
    """Whether a table with one row a source is small enough to be broadcast."""
    return goals.count() <= 100_000


def same(source: str) -> Column:
    return F.col(source).eqNullSafe(F.col("e_s"))


def cut(words: DataFrame, left: DataFrame, step: str) -> DataFrame:
    """The step of each source in which the words in order reach what is left, and the words before it."""
    run = W.partitionBy("s").orderBy(step)
    sums = words.withColumn("sum", F.sum("n").over(run.rowsBetween(W.unboundedPreceding, 0)))
    ends = sums.join(left.withColumnRenamed("s", "e_s"), same("s"), "inner")
    # the last step takes what only rounding leaves over
    top = F.max(step).over(W.partitionBy("s"))
    hit = ends.withColumn("top", top).filter((F.col("sum") >= F.col("left")) | (F.col(step) == F.col("top")))
    best = hit.groupBy("s").agg(F.min_by(F.struct(F.col(step).alias("s"), F.col("left").alias("l"), (F.col("sum") - F.col("n")).alias("b")), step).alias("e"))
    return checkpointed(best.select(F.col("s").alias("e_s"), F.col("e.s").alias(f"edge_{step}"), F.col("e.l").alias("left"), F.col("e.b").alias("before")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes; null text has size 0 and takes nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    docs = checkpointed(docs.withColumn("weight", inclusion(F.col("size"))))
    return pareto_mix(docs, weight="weight").select("doc_id", "size", "source_size", "target", "taken", "copies")


_U = "((('0x' || substr(md5('pareto:' || doc_id::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
x AS (SELECT *, CASE WHEN size > 0 THEN floor(1024.0::DOUBLE / sqrt(size::DOUBLE))::BIGINT + 1 ELSE 0 END AS x FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, encode(source))),
f AS (SELECT max(level) AS flat FROM l WHERE level <= cap / w),
t AS (SELECT source, source_size, CASE WHEN cap <= flat * w THEN cap ELSE flat * w END AS target FROM l, f),
-- the factor by which weights become copies: weights in falling order leave the sum while they are at the cap
g AS (SELECT source, x, sum(size)::BIGINT AS n, sum(x * size)::BIGINT AS xn FROM x WHERE x > 0 GROUP BY ALL),
h AS (SELECT g.*, target, (target - 3 * coalesce(sum(n) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(xn) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS factor
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source WINDOW p AS (PARTITION BY g.source ORDER BY x DESC)),
k AS (SELECT source, coalesce(arg_max(factor, x) FILTER (WHERE x * factor < 3), arg_min(factor, x)) AS factor FROM h GROUP BY source),
c AS (SELECT doc_id, size, x.source, source_size, target, least(3.0, x * coalesce(factor, 0.0)) AS want, {_U} AS u
      FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON x.source IS NOT DISTINCT FROM k.source),
p AS (SELECT *, floor(want)::BIGINT AS whole, want - floor(want) AS p FROM c),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, target - sum(whole * size) OVER (PARTITION BY source) AS rest FROM p),
r AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS run FROM q),
z AS (SELECT *, whole + CASE WHEN q IS NOT NULL AND run * 2 - size <= rest * 2 THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM z
"""
QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": OP4_SQL}
