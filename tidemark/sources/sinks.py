"""Writers and their read-back: Parquet, CSV, JSON, template-aligned output."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scoring import quantiles


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: below spark.checkpoint.dir, or a local one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _local.get("dir")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _local["dir"] = tempfile.mkdtemp(prefix="tidemark-out-")
    return f"{named.rstrip('/')}/outputs"


_local: dict[str, str] = {}


def write_parquet(df: DataFrame, name: str) -> str:
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def materialize_once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name and of the plan that builds it; built and written only if it is not complete yet.

    The name is made longer by a hash of the plan and of the files it reads, so that another input or another query is another table.
    """
    table = build()
    plan = table._jdf.queryExecution().analyzed().canonicalized().toString()
    seen = hashlib.sha256("\n".join([re.sub(r"#\d+L?", "", plan), *sorted(_versions(table))]).encode()).hexdigest()[:16]
    name = f"{name}-{seen}"
    path = f"{scratch(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        write_parquet(table, name)
    return spark.read.parquet(path)


def _versions(df: DataFrame) -> list[str]:
    """The files that a table reads, with their sizes and times."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return out


def write_csv(df: DataFrame, name: str) -> str:
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def json_round_trip(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def template_aligned(template: DataFrame, predictions: DataFrame, key: str = "event_id", value: str = "predict") -> DataFrame:
    """A row for each key of the template; missing predictions become the median of those that are there."""
    median = quantiles(predictions, value, {"__median": 0.5})
    return template.join(predictions, key, "left").crossJoin(F.broadcast(median)).select(key, F.coalesce(value, "__median").alias(value))
