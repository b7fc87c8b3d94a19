"""Linear scorers trained by gradient descent in aggregates, for objectives that Spark ML does not have.

The rows stay where they are: a round is one aggregate that returns a gradient with one number a feature.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.models import focal


def standardized(df: DataFrame, features: tuple[str, ...], like: DataFrame | None = None) -> DataFrame:
    """Column ``x``: the features less their means over their deviations (of ``like``, if given), as an array that ends in 1; nulls count as the mean."""
    stats = (like or df).agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev))])
    z = lambda i, c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{i}"), F.col(f"s_{i}")), F.lit(0.0))
    x = F.array(*[z(i, c) for i, c in enumerate(features)], F.lit(1.0))
    return df.crossJoin(F.broadcast(stats)).withColumn("x", x).select(*df.columns, "x")


def linear(w: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col("x")[i] * F.lit(float(v)) for i, v in enumerate(w)])


def descend(rows: DataFrame, pull: Callable[[DataFrame], Column], dims: int, rounds: int, rate: float) -> list[float]:
    """Weights after some rounds. ``pull`` gives the derivative of a row's loss by its score, from rows with a column ``raw``."""
    w, speed = [0.0] * dims, [0.0] * dims
    for _ in range(rounds):
        scored = rows.withColumn("raw", linear(w))
        g = scored.withColumn("g", pull(scored)).agg(F.count("g").alias("n"), *[F.sum(F.col("g") * F.col("x")[i]).alias(f"g{i}") for i in range(dims)]).first()
        if not g["n"]:
            break
        speed = [0.8 * v - rate * (g[f"g{i}"] or 0.0) / g["n"] for i, v in enumerate(speed)]
        w = [a + b for a, b in zip(w, speed)]
    return w


def focal_pull(y: str) -> Callable[[DataFrame], Column]:
    """The derivative of the focal loss."""

    def pull(rows: DataFrame) -> Column:
        p = 1 / (1 + F.exp(-F.col("raw")))
        pt = F.when(F.col(y) == 1, p).otherwise(1 - p)
        # that of -a (1 - pt)^2 log pt, with the focusing factor's own share
        d = 0.25 * (1 - pt) * (1 - pt) * (2 * pt * F.log(F.greatest(pt, F.lit(1e-12))) - (1 - pt))
        return F.when(F.col(y) == 1, d).otherwise(-d)

    return pull


def list_pull(y: str, group: str) -> Callable[[DataFrame], Column]:
    """The derivative of the cross entropy between a group's gains and the softmax of its scores; null in groups without gains, which teach nothing."""

    def pull(rows: DataFrame) -> Column:
        g = W.partitionBy(group)
        e = F.exp(F.least(F.greatest(F.col("raw"), F.lit(-100.0)), F.lit(100.0)))
        gains = F.sum(F.col(y).cast("double")).over(g)
        return F.when(gains > 0, e / F.sum(e).over(g) - F.col(y) / gains)

    return pull


def focal_loss(rows: DataFrame, y: str) -> float | None:
    return focal(rows, y, "raw").agg(F.avg("loss")).first()[0]


def ndcg(df: DataFrame, y: str, score: str, group: str, tie: str) -> DataFrame:
    """One row: the mean over groups with positives of gains discounted by log2 of rank + 1, over the best there could be."""
    w = W.partitionBy(group)
    r = F.row_number().over(w.orderBy(F.col(score).desc(), tie))
    best = F.row_number().over(w.orderBy(F.col(y).desc(), tie))
    gain = lambda k: F.sum(F.col(y) / F.log2(F.col(k) + 1))
    g = df.select(group, y, r.alias("r"), best.alias("best")).groupBy(group).agg(F.try_divide(gain("r"), gain("best")).alias("ndcg"))
    return g.agg(F.avg("ndcg").alias("ndcg"), F.count("ndcg").alias("groups"))
