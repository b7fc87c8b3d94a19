"""The corpus pipeline: documents through five operators, each stage on all that the one before kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet and read again. Filters drop what they reject and
change nothing else; the mix repeats a document as often as it takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.decontamination import without_contamination
from tidemark.llm.language_id import UNKNOWN, learn, predict
from tidemark.llm.mixing import inclusion, n_words, pareto_mix
from tidemark.llm.near_dup import one_of_each
from tidemark.llm.sharding import SHARDS, rendezvous


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under column names that clash with none of an operator's, and those names by the old ones."""
    held = docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))])
    return held, dict(zip(docs.columns, held.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear: those without text or letters (null texts too), and those with two languages all but equally near, go.

    A null language teaches nothing. Rows that repeat an id are judged each by its own text.
    """
    held, name = renamed(docs)
    model = learn(held, name["doc_id"], name["text"], name["lang"])
    found = predict(held, model, name["doc_id"], name["text"], carry=tuple(c for c in held.columns if c != name["doc_id"]))
    return found.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*[F.col(v).alias(k) for k, v in name.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (similarity 0.8): of the smallest id (null last), then of the smallest hash of the text, then of all columns.

    Rows that repeat an id are documents of their own. Null and empty texts are like no other, and all stay.
    """
    return one_of_each(docs, "doc_id", "text", num=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark, whatever its length; those of fewer than 5 words count word for word. Null and empty texts hold none."""
    return without_contamination(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. A null source is a source like others; rows without words are never taken; rows of one id draw the same number."""
    held, name = renamed(docs)
    words = held.withColumn("words", n_words(F.col(name["text"]))).withColumn("weight", inclusion(F.col("words")))
    mixed = pareto_mix(words, name["doc_id"], name["source"], "words", "weight")
    copies = mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(v).alias(k) for k, v in name.items()])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shards, by id; rows of one id, and all without one, share a shard. A column ``shard`` that is there already is replaced."""
    held, name = renamed(docs)
    placed = rendezvous(held, name["doc_id"], [1.0] * SHARDS)
    return placed.select(*[F.col(v).alias(k) for k, v in name.items() if k != "shard"], "shard")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: SQL can't express the classifier of the first stage; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
