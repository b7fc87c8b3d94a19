"""All queries of the engine: importing the plans registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import features, learners, profiling, relations, scans, scores, windowing
from tidemark.registry import ENTRIES

PLANS = (scans, windowing, profiling, features, relations, scores, learners)


def queries() -> dict:
    return {k: e.run for k, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in ENTRIES.items() if e.sql}


def covered() -> dict[str, list[str]]:
    """Inventory id -> names of the queries that cover it."""
    out: dict[str, list[str]] = {}
    for e in ENTRIES.values():
        for i in e.ids:
            out.setdefault(i, []).append(e.name)
    return out


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES["e09_anomaly"].run(spark, sf_dir)
