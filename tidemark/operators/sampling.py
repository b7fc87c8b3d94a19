"""Deterministic samples and splits by an arithmetic hash of the key: reruns agree, and rows can be added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import arith_hash, day_hash
from tidemark.operators.scoring import quantiles


def share(df: DataFrame, fraction: Column | float, seed: int = 42, key: str = "event_id") -> DataFrame:
    """Rows whose hash lies in the first fraction of its range."""
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return df.filter(arith_hash(F.col(key), seed) < f * 4294967296.0)


def ratio_sample(df: DataFrame, y: str, ratio: float, seed: int = 42) -> DataFrame:
    """Labelled rows and about ``ratio`` unlabelled ones for each positive."""
    n = df.agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.count_if(F.col(y).isNull()).alias("g"))
    n = n.select(F.try_divide(F.lit(float(ratio)) * F.col("p"), F.col("g")).alias("__f"))
    j = df.crossJoin(F.broadcast(n))
    return j.filter(F.col(y).isNotNull() | (arith_hash(F.col("event_id"), seed) < F.col("__f") * 4294967296.0)).drop("__f")


def one_day_each(df: DataFrame, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """All rows of one pseudo-random day of each entity. The day is an aggregate (min by hash), not a window over rows."""
    days = df.select(key, "date").distinct()
    h = day_hash(F.col(key), F.col("date"), seed)
    pick = days.groupBy(key).agg(F.min(F.struct(h.alias("h"), "date")).alias("m")).select(key, F.col("m.date").alias("date"))
    return df.join(pick, [key, "date"], "left_semi")


def full_days(df: DataFrame, y: str, ratio: float, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """All rows of the days that hold a label, and of about ``ratio`` times as many other days."""
    days = df.groupBy(key, "date").agg(F.max(F.col(y).isNotNull()).alias("marked"))
    n = days.agg(F.count_if("marked").alias("a"), F.count_if(~F.col("marked")).alias("b")).select(F.try_divide(F.lit(float(ratio)) * F.col("a"), F.col("b")).alias("__f"))
    h = day_hash(F.col(key), F.col("date"), seed)
    pick = days.crossJoin(F.broadcast(n)).filter(F.col("marked") | (h < F.col("__f") * 4294967296.0))
    return df.join(pick.select(key, "date"), [key, "date"], "left_semi")


def hard_negatives(df: DataFrame, y: str, score: str, top: float, easy: float, seed: int = 42) -> DataFrame:
    """Positives, negatives scored in the top share, and a share of the other negatives."""
    bar = quantiles(df.filter(F.col(y) == 0), score, {"__bar": 1 - top})
    j = df.crossJoin(F.broadcast(bar))
    kept = (F.col(y) == 1) | (F.col(score) >= F.col("__bar")) | (arith_hash(F.col("event_id"), seed) < easy * 4294967296.0)
    return j.filter(kept).drop("__bar")


def fixed_size(df: DataFrame, n: int, seed: int = 42, key: str = "event_id") -> DataFrame:
    """Exactly n rows (or all): those of least hash, by a top-k."""
    return df.orderBy(arith_hash(F.col(key), seed), key).limit(n)


def shuffled(df: DataFrame, seed: int = 42, key: str = "event_id") -> DataFrame:
    """The whole table in the order of the key's hash: rows of a partition, and the partitions, follow each other in it."""
    return df.orderBy(arith_hash(F.col(key), seed), key)


def folds(df: DataFrame, y: str, k: int, seed: int = 42, key: str = "event_id", ranges: int | None = None) -> DataFrame:
    """Stratified folds: within each label, rows in hash order are dealt round-robin.

    The order of a label is numbered in ranges of the hash, each after the counts of the ranges before it.
    """
    ranges = ranges or max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    h = arith_hash(F.col(key), seed)
    d = df.withColumn("__h", h).withColumn("__r", F.floor(F.col("__h") * ranges / 4294967296.0))
    counts = d.groupBy(y, "__r").agg(F.count("*").alias("__n"))
    before = W.partitionBy(y).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(y).alias("__y"), F.col("__r").alias("__r2"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(y, "__r").orderBy("__h", key))
    j = d.withColumn("__k", inside).join(F.broadcast(offsets), F.col(y).eqNullSafe(F.col("__y")) & (F.col("__r") == F.col("__r2")))
    return j.withColumn("fold", F.pmod(F.col("__before") + F.col("__k") - 1, F.lit(k)).cast("int")).drop("__h", "__r", "__k", "__y", "__r2", "__before")
