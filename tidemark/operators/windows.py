"""Window operators of one entity's events in time order.

All specifications that start with the same key share one shuffle and one sort, so
functions return columns; put those of one key into one select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND, SPANS, clip_lo

KEY = "customer_id"


def ordered(*key: str):
    return W.partitionBy(*(key or (KEY,))).orderBy("us", "event_id")


def trailing(span: int, key: str = KEY):
    """The frame [t - span, t): all rows of time t itself are left out."""
    return W.partitionBy(key).orderBy("us").rangeBetween(-span, -1)


def before(*key: str):
    """All rows before this one."""
    return ordered(*key).rowsBetween(W.unboundedPreceding, -1)


def velocity(spans: dict[str, int] = SPANS, amount: str = "amt") -> dict[str, Column]:
    """Counts (0 if the frame is empty) and sums (null then) of the trailing windows."""
    out: dict[str, Column] = {}
    for name, span in spans.items():
        out[f"cnt_{name}"] = F.count("*").over(trailing(span)).cast("int")
        out[f"amt_sum_{name}"] = F.sum(amount).over(trailing(span))
    return out


def since_last() -> Column:
    return (F.col("us") - F.lag("us").over(ordered())) / SECOND


def first_seen(c: str, key: str = KEY) -> Column:
    """1 if the value of ``c`` is new for the entity; null never is."""
    return ((F.row_number().over(ordered(key, c)) == 1) & F.col(c).isNotNull()).cast("int")


def running_non_null(c: str) -> Column:
    return F.count(c).over(ordered().rowsBetween(W.unboundedPreceding, 0))


def session_before(df: DataFrame, session: str = "session_id", amount: str = "amt", row: str = "event_id") -> DataFrame:
    """Operations and amount of the session before each event; 0 without a session.

    Rows without a session are keyed by themselves in the same window: keyed by null they would be one giant partition.
    """
    alone = F.when(F.col(session).isNull(), F.col(row))
    w = W.partitionBy(session, alone).orderBy("us", "event_id")
    amount_before = F.coalesce(F.sum(amount).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return df.select("*", F.when(F.col(session).isNull(), 0).otherwise((F.row_number().over(w) - 1).cast("int")).alias("session_ops_before"), F.when(F.col(session).isNull(), 0.0).otherwise(amount_before).alias("session_amt_before"))


def history(df: DataFrame) -> DataFrame:
    """The history features of every event, from one shuffle by entity and one by session."""
    cols = velocity() | {"secs_since_last": since_last(), "voip_cnt_24h": F.sum("voip").over(trailing(SPANS["24h"])), "cum_unique_mcc_approx": running_non_null("mcc")}
    # hash(entity) also clusters (entity, value), so the novelty windows need no further shuffle
    wide = df.repartition(KEY).select("*", *[v.alias(k) for k, v in cols.items()], first_seen("mcc").alias("is_new_mcc"), first_seen("event_type").alias("is_new_type"))
    return session_before(wide)


def exclusive_running(measures: dict[str, tuple[str, Column]], *key: str) -> dict[str, Column]:
    """Running aggregates over the rows strictly before: name -> (sum|count|min|max, column)."""
    f = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    return {k: f[kind](c).over(before(*key)) for k, (kind, c) in measures.items()}


def group_rank(score: str = "score", key: str = KEY, tie: str = "event_id") -> tuple[Column, Column]:
    """Rank within the entity (0 is the highest) and rank over group size less one."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(score).desc(), tie)) - 1
    return rank, rank / clip_lo(F.count("*").over(W.partitionBy(key)) - 1, 1)
