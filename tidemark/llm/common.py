"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine may leave it unset (tests), and gets a local
    folder of its own; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or _local.get("dir")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _local["dir"] = tempfile.mkdtemp(prefix="tidemark-")
    return named.rstrip("/")


_local: dict[str, str] = {}


def written(df: DataFrame, label: str = "cut", codec: str = "zstd") -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back.

    A written table survives lost executors, and its plan starts anew: a Dataset
    checkpoint keeps the constraints of the plan before it, which grow from round to round.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``written`` for narrow tables that are read more than once."""
    return written(df, codec="snappy")


#: Rows of a narrow table (keys and hashes, some 50 bytes a row) up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def for_join(narrow: DataFrame, rows: int) -> DataFrame:
    """A narrow table with so many rows as a join's side: broadcast up to BROADCAST_ROWS, beyond that both sides are sorted and merged."""
    return F.broadcast(narrow) if rows <= BROADCAST_ROWS else narrow.hint("merge")


def utf8(text: Column) -> Column:
    """The text's bytes; null counts as empty."""
    return F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")


def python_on_executors(spark: SparkSession, rows: int = 1000) -> None:
    """Before an operator runs Python: small Arrow batches, so that very long texts fit in a worker, and this package on the workers.

    Workers that share the driver's PYTHONPATH have the package; else Spark hands it out with the job.
    """
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def _ship(spark: SparkSession) -> None:
    package = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or not package.is_dir() or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    path = f"{tempfile.mkdtemp(prefix='tidemark-')}/tidemark.zip"  # on the driver; its file server hands it out
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)


_shipped: set[str] = set()


def unit_interval(*parts: Column) -> Column:
    """A number in (0, 1) that only the given values decide: 52 bits of MD5.

    MD5 because every SQL engine has it, so that the draw can be checked outside Spark.
    """
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def join_by_frequency(left: DataFrame, stats: DataFrame, key: str, count: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join to a table with one row per key, where a key may hold a large part of the rows.

    Keys with more than total/parts rows number less than ``parts``: these are
    broadcast. The rest are shuffled; rows already matched are spread by their own
    values. ``stats`` is read twice, so give it materialised; its columns besides
    key and count are added to ``left``.
    """
    cols = [c for c in stats.columns if c not in (key, count)]
    bar = max(1, total // parts)
    hot = stats.filter(F.col(count) > bar).select(F.col(key).alias("__hot"), F.struct(*cols).alias("__h"))
    cold = stats.filter(F.col(count) <= bar).select(F.col(key).cast("string").alias("__cold"), F.struct(*cols).alias("__c"))
    one = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    spread = F.concat(F.lit("!"), F.xxhash64(*[c for c in left.columns]).cast("string"))
    one = one.withColumn("__k", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(spread))
    two = one.join(cold, F.col("__k") == F.col("__cold"), "left").withColumn("__v", F.coalesce("__h", "__c"))
    return two.select(*left.columns, *[F.col(f"__v.{c}").alias(c) for c in cols])
