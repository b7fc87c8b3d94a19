"""A stream's finished windows equal the batch rows."""

from pyspark.sql import functions as F

from tidemark.operators import profiles
from tidemark.sources.views import tx
from tidemark.streaming import windows


def test_day_stats_of_a_stream_are_those_of_the_batch(spark, sf, tmp_path):
    d = tx(spark, sf)
    rows = d.select("customer_id", "event_dttm", "amt")
    rows.write.parquet(str(tmp_path / "in"))
    late = rows.limit(1).withColumn("event_dttm", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).withColumn("customer_id", F.lit(-1).cast("long"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(str(tmp_path / "in"))
    q = windows.day_stats(stream).writeStream.format("memory").queryName("day_stats").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past every day
    q.processAllAvailable()
    q.stop()
    want = profiles.day_stats(d).select("customer_id", "date", "day_n_ops", F.round("day_total_amt", 4).alias("t"), "day_max_amt")
    got = spark.table("day_stats").select("customer_id", "date", "day_n_ops", F.round("day_total_amt", 4).alias("t"), "day_max_amt")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions(spark):
    t = [0, 10, 60, 200, 205]
    d = spark.createDataFrame([(1, m, 1.0) for m in t], "customer_id long, m int, amt double").select("customer_id", F.timestamp_seconds(F.col("m") * 60 + 1704067200).alias("event_dttm"), "amt")
    assert sorted(r["n_ops"] for r in windows.sessions(d).collect()) == [1, 2, 2]
