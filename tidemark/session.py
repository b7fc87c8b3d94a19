"""Session defaults; nothing here is needed if the cluster sets its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, cores: int = 8) -> SparkSession:
    b = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master).config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
    return b.getOrCreate()
