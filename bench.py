"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

QUERIES = (
    "w01_velocity",
    "w08_history",
    "w12_exclusive_running",
    "w14_point_in_time",
    "w16_entity_scores",
    "w18_average_ranks",
    "p01_basic_profile",
    "p02_deep_profile",
    "p06_entropy",
    "p08_gaps",
    "e09_anomaly",
    "e14_pit_anomaly",
    "e17_sequence",
    "e18_day_context",
    "g01_device_graph",
    "j09_as_of_lookup",
    "m03_one_day_each",
    "n02_leave_one_out",
    "x03_weight_grid",
    "x08_average_precision",
    "x11_precision_at_k",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark import catalog

    run = catalog.queries()
    once = lambda name: run[name](spark, sf).write.format("noop").mode("overwrite").save()
    once("e09_anomaly")  # start the JVM's compilers
    took = {}
    for name in QUERIES:
        began = time.time()
        once(name)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
