"""Categorical encodings. Statistics come from training rows; unseen values get the prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def target_stats(train: DataFrame, c: str, y: str = "y", smoothing: float = 20.0) -> DataFrame:
    """(value, te): the smoothed label mean of each value."""
    mu = train.agg(F.avg(y).alias("mu"))
    g = train.groupBy(c).agg(F.sum(y).alias("s"), F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(mu)).select(c, ((F.col("s") + F.col("mu") * smoothing) / (F.col("n") + smoothing)).alias("te"))


def apply_target(df: DataFrame, train: DataFrame, c: str, y: str = "y", smoothing: float = 20.0) -> DataFrame:
    mu = train.agg(F.avg(y).alias("__mu"))
    j = df.join(target_stats(train, c, y, smoothing), c, "left").crossJoin(F.broadcast(mu))
    return j.withColumn("te", F.coalesce("te", "__mu")).drop("__mu")


def leave_one_out(train: DataFrame, c: str, y: str = "y", smoothing: float = 20.0) -> DataFrame:
    """The smoothed mean of the other rows of the value; a value with one row gets the prior.

    Sums are aggregated and joined back, so a frequent value is no single window partition.
    """
    mu = train.agg(F.avg(y).alias("__mu"))
    g = train.groupBy(F.col(c).alias("__c")).agg(F.sum(y).alias("__s"), F.count("*").alias("__n"))
    j = train.join(g, F.col(c).eqNullSafe(F.col("__c")), "left").crossJoin(F.broadcast(mu))
    rest = F.col("__n") - 1 + smoothing
    loo = F.when(F.col("__n") == 1, F.col("__mu")).otherwise((F.col("__s") - F.col(y)) / rest + F.col("__mu") * smoothing / rest)
    return j.withColumn("te_loo", loo).drop("__c", "__s", "__n", "__mu")


def frequency(df: DataFrame, train: DataFrame, c: str) -> DataFrame:
    """The share of training rows with the value; 0 if unseen."""
    total = train.agg(F.count("*").alias("__t"))
    g = train.groupBy(F.col(c).alias("__c")).agg(F.count("*").alias("__n"))
    j = df.join(g, F.col(c).eqNullSafe(F.col("__c")), "left").crossJoin(F.broadcast(total))
    return j.withColumn("freq", F.coalesce(F.col("__n") / F.col("__t"), F.lit(0.0))).drop("__c", "__n", "__t")
