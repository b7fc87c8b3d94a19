"""Isolation forest: random trees on bounded samples, scored by built-in expressions."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import arith_hash

#: Trees, and rows in the sample of each: the samples together are the bound of what the driver holds.
TREES, SAMPLE = 12, 64


def usual(n: int) -> float:
    """The mean length of an unsuccessful search in a tree of n rows."""
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grown(rows: list[tuple], depth: int, rng: random.Random) -> tuple:
    """A tree: (feature, threshold, left, right), or (path length,) at a leaf."""
    width = len(rows[0]) if rows else 0
    open_ = [k for k in range(width) if min(r[k] for r in rows) < max(r[k] for r in rows)]
    if depth == 0 or len(rows) < 2 or not open_:
        return (usual(len(rows)),)
    k = rng.choice(open_)
    lo, hi = min(r[k] for r in rows), max(r[k] for r in rows)
    cut = rng.uniform(lo, hi)
    cut = cut if lo < cut else hi
    return k, cut, grown([r for r in rows if r[k] < cut], depth - 1, rng), grown([r for r in rows if r[k] >= cut], depth - 1, rng)


def path(tree: tuple, columns: list[Column], depth: int = 0) -> Column:
    if len(tree) == 1:
        return F.lit(depth + tree[0])
    return F.when(columns[tree[0]] < F.lit(tree[1]), path(tree[2], columns, depth + 1)).otherwise(path(tree[3], columns, depth + 1))


def forest(df: DataFrame, features: tuple[str, ...], key: str = "event_id", trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> list[tuple]:
    """Trees on the rows of least hash, a different sample for each tree; null features count as 0."""
    picked = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]).orderBy(arith_hash(F.col(key), seed), key).limit(trees * sample).collect()
    rows = [tuple(r[c] for c in features) for r in picked]
    rng = random.Random(seed)
    return [grown(rows[k::trees], math.ceil(math.log2(max(2, sample))), rng) for k in range(trees)]


def anomaly(df: DataFrame, model: list[tuple], features: tuple[str, ...], out: str = "anomaly", sample: int = SAMPLE) -> DataFrame:
    """Scores from 0 to 1: 2 to the minus mean path length over the usual length; rows that few cuts set apart are near 1."""
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    mean = sum((path(t, columns) for t in model), F.lit(0.0)) / len(model)
    return df.withColumn(out, F.pow(F.lit(2.0), -mean / usual(sample)))
