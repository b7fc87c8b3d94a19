"""Scores of all rows: ranks, quantiles, average precision, ROC area, precision at K, without a window over everything.

A window without a partition would pull all rows into one task, and so would an exact percentile. Both
are built from counts of distinct values: these are summed by ranges of the value,
so that each range is numbered in its own task after the sums of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the score that are numbered apart: the least, and the most, between which they are twice the shuffle partitions.
RANGES, MOST_RANGES = 16, 1024


def prefix_counts(df: DataFrame, score: str, aggs: dict[str, Column], desc: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """For each distinct score (of each group): its aggregates, and ``<name>_before``, their sums over all scores ahead of it.

    The input is aggregated once: the bounds of the ranges come from the counts, whose exchange is used again.
    """
    spark = df.sparkSession
    ranges = min(MOST_RANGES, max(RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counts = df.groupBy(*by, F.col(score).alias("s")).agg(*[v.alias(k) for k, v in aggs.items()])
    # all aggregates are read here too, so that both sides need the same exchange
    read = F.coalesce(*[F.sum(k).cast("double") for k in aggs], F.lit(0.0)).alias("__read")
    bounds = counts.agg(F.percentile_approx("s", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(8 * ranges)).alias("__b"), read).select(F.array_distinct("__b").alias("__b"), "__read")
    # the bounds below a score are counted in two steps: every k-th of them, then those between
    k = int(ranges**0.5 + 0.5)
    below = lambda bounds: F.size(F.filter(bounds, lambda x: x < F.col("s")))
    placed = counts.crossJoin(F.broadcast(bounds.withColumn("__c", F.filter("__b", lambda x, i: (i + 1) % k == 0)))).withColumn("__i", below(F.col("__c")) * k)
    placed = placed.withColumn("__range", F.when(F.col("__read").isNotNull(), F.col("__i") + below(F.slice("__b", F.col("__i") + 1, F.lit(k))))).drop("__b", "__c", "__i", "__read")
    sums = placed.groupBy(*by, "__range").agg(*[F.sum(k).alias(k) for k in aggs])
    order = F.col("__range").desc() if desc else F.col("__range").asc()
    ahead = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col("__range").alias("__r"), *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"__{k}") for k in aggs])
    here = F.col("__range").eqNullSafe(F.col("__r"))
    for i, c in enumerate(by):
        here = here & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inside = W.partitionBy(*by, "__range").orderBy(F.col("s").desc() if desc else F.col("s").asc()).rowsBetween(W.unboundedPreceding, -1)
    run = placed.join(offsets if by else F.broadcast(offsets), here)
    return run.select(*by, "s", *aggs, *[(F.col(f"__{k}") + F.coalesce(F.sum(k).over(inside), F.lit(0))).alias(f"{k}_before") for k in aggs])


def quantiles(df: DataFrame, value: str, qs: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles (of each group) with linear interpolation, as ``percentile`` gives them, nulls left out; without values, no group and null."""
    p = prefix_counts(df.filter(F.col(value).isNotNull()), value, {"n": F.count("*")}, desc=False, by=by)
    total = p.groupBy(*by).agg(F.sum("n").alias("__n")).withColumnsRenamed({c: f"__{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    j = p.join(total, on) if by else p.crossJoin(F.broadcast(total))
    at = lambda k: F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col("s")))
    out = []
    for name, q in qs.items():
        place = (F.col("__n") - 1) * F.lit(q)
        low, part = at(F.floor(place)), F.max(place - F.floor(place))
        out.append((low + (at(F.ceil(place)) - low) * part).alias(name))
    return j.groupBy(*by).agg(*out)


def global_average_rank(df: DataFrame, score: str, out: str) -> DataFrame:
    """Ranks from 1 over all rows; ties share their mean rank."""
    p = prefix_counts(df, score, {"n": F.count("*")}, desc=False)
    ranks = p.select(F.col("s").alias("__s"), (F.col("n_before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(score).eqNullSafe(F.col("__s"))).drop("__s")


def ordinal(df: DataFrame, score: str, tie: str, out: str, desc: bool = False) -> DataFrame:
    """Row numbers from 1 over all rows by (score, tie), which tell rows apart. Rows of one score are numbered by ranges of the tie."""
    p = prefix_counts(df, score, {"n": F.count("*")}, desc=desc).select(F.col("s").alias("__s"), F.col("n_before").alias("__b"))
    t = prefix_counts(df, tie, {"n": F.count("*")}, desc=False, by=(score,)).select(F.col(score).alias("__s2"), F.col("s").alias("__t"), F.col("n_before").alias("__k"))
    j = df.join(t, F.col(score).eqNullSafe(F.col("__s2")) & F.col(tie).eqNullSafe(F.col("__t"))).join(p, F.col(score).eqNullSafe(F.col("__s")))
    return j.withColumn(out, F.col("__b") + F.col("__k") + 1).drop("__s", "__b", "__k", "__s2", "__t")


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: ap = sum over scores, highest first, of recall gained times precision; null without positives."""
    p = prefix_counts(df, score, {"n": F.count("*"), "tp": F.sum(F.col(y).cast("long"))})
    ap = F.sum(F.col("tp") * (F.col("tp_before") + F.col("tp")) / (F.col("n_before") + F.col("n")))
    return p.agg(F.try_divide(ap, F.sum("tp")).alias("ap"), F.sum("tp").alias("positives"), F.sum("n").alias("n"))


def average_precision_by(df: DataFrame, y: str, score: str, *by: str) -> DataFrame:
    """Average precision of each group; groups of any size are spread over ranges of the score."""
    p = prefix_counts(df, score, {"n": F.count("*"), "tp": F.sum(F.col(y).cast("long"))}, by=by)
    ap = F.sum(F.col("tp") * (F.col("tp_before") + F.col("tp")) / (F.col("n_before") + F.col("n")))
    return p.groupBy(*by).agg(F.try_divide(ap, F.sum("tp")).alias("ap"), F.sum("tp").alias("positives"), F.sum("n").alias("n"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: the share of (positive, negative) pairs in order, ties half; null if a class is empty."""
    p = prefix_counts(df, score, {"n": F.count("*"), "tp": F.sum(F.col(y).cast("long"))}, desc=False)
    pos, n = F.sum("tp"), F.sum("n")
    ranks = F.sum(F.col("tp") * (F.col("n_before") + (F.col("n") + 1) / 2))
    return p.agg(F.try_divide(ranks - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))


def precision_at(df: DataFrame, y: str, score: str, tie: str, ks: tuple[int, ...]) -> DataFrame:
    """(k, tp, precision, recall): the top rows come from one bounded top-k."""
    top = df.select(score, y, tie).orderBy(F.col(score).desc(), tie).limit(max(ks))
    ranked = top.withColumn("k0", F.row_number().over(W.orderBy(F.col(score).desc(), tie)))
    sums = ranked.agg(*[F.sum(F.when(F.col("k0") <= k, F.col(y))).alias(f"k{k}") for k in ks])
    total = df.agg(F.sum(y).alias("positives"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").cast("long").alias("tp")) for k in ks]))
    return sums.select(rows.alias("r")).crossJoin(total).select("r.k", "r.tp", (F.col("r.tp") / F.col("r.k")).alias("precision"), F.try_divide(F.col("r.tp").cast("double"), F.col("positives")).alias("recall"))
