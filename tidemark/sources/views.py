"""Typed canonical views over the tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import arith_hash, iso_weekday, micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions: unique times, microseconds, some null codes and sessions."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("*", k.alias("k"))
    day = F.dayofmonth("ts")
    return e.select(
        F.col("user_id").alias("customer_id"),
        "event_id",
        F.col("ts").alias("event_dttm"),
        micros(F.col("ts")).alias("us"),
        F.col("value").alias("amt"),
        "event_type",
        F.when(F.col("k") % 10 != 0, F.col("k")).alias("mcc"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("voip"),
        F.when(F.col("k") % 10 != 0, F.col("k") % 5).alias("pos"),
        F.when(F.col("k") % 7 != 0, F.col("user_id") * 1000 + day).alias("session_id"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 60), 1).when((F.col("event_type") == "signup") & (F.col("value") > 60), 0).alias("target"),
        F.when(day < 11, "pretrain").when(day < 21, "train").when(day < 26, "pretest").otherwise("test").alias("period"),
        F.hour("ts").alias("hour"),
        iso_weekday(F.col("ts")).alias("weekday"),
        F.to_date("ts").alias("date"),
    )


TX = """WITH tx AS (
  SELECT user_id AS customer_id, event_id, ts AS event_dttm, epoch_us(ts) AS us, value AS amt, event_type,
    CASE WHEN k % 10 <> 0 THEN k END AS mcc, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS voip,
    CASE WHEN k % 10 <> 0 THEN k % 5 END AS pos, CASE WHEN k % 7 <> 0 THEN user_id * 1000 + day(ts) END AS session_id,
    CASE WHEN event_type = 'error' AND value > 60 THEN 1 WHEN event_type = 'signup' AND value > 60 THEN 0 END AS target,
    CASE WHEN day(ts) < 11 THEN 'pretrain' WHEN day(ts) < 21 THEN 'train' WHEN day(ts) < 26 THEN 'pretest' ELSE 'test' END AS period,
    hour(ts)::INT AS hour, isodow(ts)::INT AS weekday, ts::DATE AS date
  FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events))"""


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: several years, tied times."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").alias("event_dttm"),
        micros(F.col("o_orderdate")).alias("us"),
        F.col("o_totalprice").alias("amt"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("event_type"),
        F.col("o_orderstatus").alias("channel"),
    )


TXO = """WITH txo AS (SELECT o_custkey AS customer_id, o_orderkey AS event_id, o_orderdate AS event_dttm, epoch_us(o_orderdate) AS us,
  o_totalprice AS amt, substr(o_orderpriority, 1, 1)::INT AS event_type, o_orderstatus AS channel FROM orders)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx with two deterministic pseudo-scores and a binary label."""
    d = tx(spark, sf_dir)
    s1, s2 = F.col("amt") / (F.col("amt") + 50), arith_hash(F.col("event_id")) / 4294967296.0
    return d.withColumns({"s1": s1, "s2": s2, "y": F.col("voip")}).withColumn("s3", 0.5 * F.col("s1") + 0.5 * F.col("s2"))


SC = TX + """, sc AS (SELECT *, 0.5::DOUBLE * s1 + 0.5::DOUBLE * s2 AS s3 FROM (
  SELECT *, amt / (amt + 50) AS s1, (((event_id * 2654435761::HUGEINT + 42 * 40503) % 4294967296 + 4294967296) % 4294967296)::DOUBLE / 4294967296.0::DOUBLE AS s2, voip AS y FROM tx))"""
