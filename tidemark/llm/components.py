"""Connected components of links by smallest labels, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, join_by_frequency

#: Rounds of plain spreading before labels also jump to their label's label: shallow groups end sooner without.
PLAIN_ROUNDS = 3


def components(links: DataFrame, node: str = "node", hub: str = "hub") -> DataFrame:
    """(node, label) of all ends of the links; the label is the smallest node that can be reached.

    In each round every node takes the smallest label among its neighbours; the rounds
    end when nothing changes, after about twice the logarithm of the longest path.
    A node with a large part of all links is joined by broadcast. A link from a node to itself
    counts for nothing; empty links give an empty table.
    """
    pairs = links.select(F.col(node).alias("u"), F.col(hub).alias("v")).filter("u <> v")
    edges = checkpointed(pairs.union(pairs.select("v", "u")).distinct())
    total = edges.count()
    labels = checkpointed(edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")).select(F.col("u").alias("node"), "n", F.least("u", "m").alias("label")))
    rounds = 0
    while total:
        rounds += 1
        near = join_by_frequency(edges, labels.withColumnRenamed("node", "v"), "v", "n", total).groupBy("u").agg(F.min("label").alias("m"))
        labels = labels.join(near, F.col("node") == F.col("u")).select("node", "n", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        if rounds > PLAIN_ROUNDS:
            low = checkpointed(labels)
            counts = low.groupBy(F.col("label").alias("x")).agg(F.count("*").alias("k"))
            own = checkpointed(counts.join(low.select("node", F.col("label").alias("next")), F.col("x") == F.col("node")).select(F.col("x").alias("label"), "k", "next"))
            labels = join_by_frequency(low, own, "label", "k", total).select("node", "n", F.least("label", "next").alias("label"), "old")
        labels = checkpointed(labels)
        if labels.filter("label <> old").isEmpty():
            break
        labels = labels.drop("old")
    return labels.select("node", "label")
