"""Structured Streaming counterparts of the day statistics and of sessions.

The batch operators are the reference for results: over the same finished input a
stream's appended windows equal the batch rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "customer_id"


def day_stats(events: DataFrame, late: str = "1 hour", time: str = "event_dttm") -> DataFrame:
    """Count, sum and maximum of each entity's days. ``late`` bounds both how long an event may be late and the state that is kept."""
    day = F.window(F.col(time), "1 day")
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = timed.groupBy(KEY, day.alias("day")).agg(F.count("*").alias("day_n_ops"), F.sum("amt").alias("day_total_amt"), F.max("amt").alias("day_max_amt"))
    return g.select(KEY, F.to_date("day.start").alias("date"), "day_n_ops", "day_total_amt", "day_max_amt")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "event_dttm") -> DataFrame:
    """Activity sessions: runs of an entity's events with no pause of ``gap`` or more."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = timed.groupBy(KEY, F.session_window(F.col(time), gap).alias("s")).agg(F.count("*").alias("n_ops"), F.sum("amt").alias("total_amt"))
    return g.select(KEY, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_ops", "total_amt")
