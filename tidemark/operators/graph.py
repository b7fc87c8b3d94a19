"""Aggregates over the bipartite graph of devices and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame, marked: DataFrame, device: str = "device", customer: str = "customer_id") -> DataFrame:
    """Customers of each device, how many of them are marked, and their share. Edges are distinct pairs."""
    m = marked.select(customer, F.lit(1).alias("m"))
    n, k = F.count("*"), F.coalesce(F.sum("m"), F.lit(0))
    return edges.join(m, customer, "left").groupBy(device).agg(n.alias("dev_n_customers"), k.alias("dev_n_fraud_customers"), (k / n).alias("dev_fraud_rate"))
