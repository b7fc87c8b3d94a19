"""Small hand-written frames for the cases in which engines differ."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import arith_hash, avg_rank, clip_lo, day_hash
from tidemark.operators import features, profiles, sampling, scoring, windows
from tidemark.sources import sinks

HOUR = 3600 * 1_000_000


def frame(spark, rows, schema="customer_id long, event_id long, us long, amt double, mcc int, voip int, session_id long"):
    return spark.createDataFrame(rows, schema)


def by_id(df, c):
    return [r[c] for r in df.orderBy("event_id").collect()]


def test_clip_keeps_null(spark):
    d = spark.createDataFrame([(None,), (0.5,), (3.0,)], "x double")
    assert [r[0] for r in d.select(clip_lo(F.col("x"), 1.0)).collect()] == [None, 1.0, 3.0]


def test_ties_and_edges_of_trailing_windows(spark):
    t = [0, 0, 10_000_000, HOUR, HOUR + 1]
    d = frame(spark, [(1, i, us, 5.0, 1, 0, 1) for i, us in enumerate(t)])
    v = windows.velocity({"1h": HOUR})
    out = d.select("event_id", v["cnt_1h"].alias("c"), v["amt_sum_1h"].alias("s"))
    assert by_id(out, "c") == [0, 0, 2, 3, 2]  # rows of the same time are left out, t - 1 h is in, beyond is not
    assert by_id(out, "s") == [None, None, 10.0, 15.0, 10.0]


def test_novelty_ignores_null(spark):
    d = frame(spark, [(1, 0, 0, 1.0, None, 0, 1), (1, 1, 1, 1.0, 7, 0, 1), (1, 2, 2, 1.0, 7, 0, 1), (1, 3, 3, 1.0, None, 0, 1)])
    assert by_id(d.select("event_id", windows.first_seen("mcc").alias("n")), "n") == [0, 1, 0, 0]


def test_null_sessions_stand_alone(spark):
    d = frame(spark, [(1, 0, 0, 1.0, 1, 0, None), (2, 1, 1, 2.0, 1, 0, None), (1, 2, 2, 3.0, 1, 0, 9), (1, 3, 3, 4.0, 1, 0, 9)])
    out = windows.session_before(d)
    assert by_id(out, "session_ops_before") == [0, 0, 0, 1]
    assert by_id(out, "session_amt_before") == [0.0, 0.0, 0.0, 3.0]


def test_mode_takes_the_smaller_of_equals(spark):
    d = frame(spark, [(1, i, i, 1.0, m, 0, 1) for i, m in enumerate([5, 3, 5, 3, 9])])
    assert tuple(profiles.mode(d, "mcc").first()) == (1, 3, 2)


def test_gaps_are_over_the_union(spark):
    us = [0, 1, 3, 6, 106]
    d = frame(spark, [(1, i, s * 1_000_000, 1.0, 1, 0, 1) for i, s in enumerate(us)])
    assert profiles.gaps(d).first()["prof_gap_p95"] == pytest.approx(85.45)


def test_distinct_counts_null_once(spark):
    d = frame(spark, [(1, i, i, 1.0, m, 0, 1) for i, m in enumerate([None, 1, None, 2])])
    assert d.groupBy("customer_id").agg(profiles.distinct_with_null("mcc").alias("n")).first()["n"] == 3


def test_average_ranks(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    assert sorted(r[0] for r in d.select(avg_rank(F.col("v"))).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert sorted(r["k"] for r in scoring.global_average_rank(d, "v", "k").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_average_precision(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)], "y int, s double")
    assert scoring.average_precision(tied, "y", "s").first()["ap"] == 0.25
    best = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.5), (0, 0.1)], "y int, s double")
    assert scoring.average_precision(best, "y", "s").first()["ap"] == 1.0
    assert scoring.roc_auc(best, "y", "s").first()["auc"] == 1.0
    none = best.filter("y = 0")
    assert scoring.average_precision(none, "y", "s").first()["ap"] is None
    assert scoring.roc_auc(none, "y", "s").first()["auc"] is None


def test_precision_counts_grow_with_k(spark):
    d = spark.createDataFrame([(i, i % 3 == 0, float(i % 7)) for i in range(50)], "event_id long, b boolean, s double").withColumn("y", F.col("b").cast("int"))
    tp = [r["tp"] for r in scoring.precision_at(d, "y", "s", "event_id", (5, 10, 20, 50)).orderBy("k").collect()]
    assert tp == sorted(tp) and tp[-1] == 17


def test_unknown_customer_has_zero_deviation(spark):
    d = frame(spark, [(1, 0, 0, 1.0, 1, 0, 1)]).withColumns({"hour": F.lit(1), "cnt_30d": F.lit(0)})
    p = spark.createDataFrame([], "customer_id long, cust_avg_amt double, cust_std_amt double, cust_med_amt double, cust_last_epoch double, cust_avg_hour double, cust_avg_gap_sec double, cust_max_amt double, cust_p95_amt double")
    r = features.customer_deviation(d, p).first()
    assert r["amt_zscore"] == 0.0 and r["is_new_customer"] == 1


def test_samples_do_not_hang_on_row_order(spark):
    d = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    a = {r[0] for r in sampling.share(d, 0.3).select("event_id").collect()}
    b = {r[0] for r in sampling.share(d.orderBy(F.rand(3)), 0.3).select("event_id").collect()}
    assert a == b and 200 < len(a) < 400
    f = sampling.folds(d, "y", 5).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["fold"]): r["count"] for r in f} == {(y, k): 20 if y else 180 for y in (0, 1) for k in range(5)}


def test_template_fills_the_median(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "event_id long")
    p = spark.createDataFrame([(1, 0.2), (3, 0.4)], "event_id long, predict double")
    assert by_id(sinks.template_aligned(t, p), "predict") == pytest.approx([0.2, 0.3, 0.4])


def test_history_does_not_hang_on_row_order(spark):
    rows = [(i % 3, i, (i * 7919 % 97) * 60_000_000, float(i % 5), i % 4 or None, i % 2, i % 6 or None) for i in range(90)]
    d = frame(spark, rows).withColumn("event_type", F.lit("x"))
    a = windows.history(d).orderBy("event_id").collect()
    b = windows.history(d.orderBy(F.rand(1))).orderBy("event_id").collect()
    assert a == b


def test_pretest_profiles_fall_back(spark):
    """Customer 1 has pretest rows, 2 only pretrain rows, 3 neither."""
    keep = ("prof_amt_mean", "prof_amt_std", "prof_amt_median", "prof_hour_mean")
    profile = lambda rows: spark.createDataFrame(rows, "customer_id long, " + ", ".join(f"{c} double" for c in keep))
    d = spark.createDataFrame([(1, 1, 30.0, 5, 10), (1, 2, 30.0, 6, 10), (2, 3, 30.0, 5, 10), (3, 4, 30.0, 5, 10)], "customer_id long, event_id long, amt double, mcc int, hour int")
    new, old = profile([(1, 10.0, 2.0, 10.0, 9.0)]), profile([(1, 99.0, 9.0, 99.0, 0.0), (2, 20.0, 5.0, 15.0, 12.0)])
    mcc = spark.createDataFrame([(1, 5, 7)], "customer_id long, mcc int, mcc_n long")
    out = features.pretest_anomalies(d, old, new, mcc)
    assert by_id(out, "pt_amt_zscore") == [10.0, 10.0, 2.0, None] and by_id(out, "pt_amt_vs_median") == [3.0, 3.0, 2.0, None]
    assert by_id(out, "pt_hour_deviation") == [1.0, 1.0, 2.0, None] and by_id(out, "pt_mcc_novel") == [0, 1, 1, 1]


def test_template_fills_missing_predictions(spark):
    template = spark.range(4).withColumnRenamed("id", "event_id")
    pred = spark.createDataFrame([(0, 0.1), (1, 0.4), (2, None)], "event_id long, predict double")
    assert by_id(sinks.template_aligned(template, pred), "predict") == [0.1, 0.4, 0.25, 0.25]


def test_registered_over_all_rows(spark, sf):
    """Every test customer with history in the pretest has a profile of it, and every test event its own prediction."""
    from tidemark import catalog
    from tidemark.sources.views import tx

    q = catalog.queries()
    d = tx(spark, sf)
    known = d.filter("period = 'test'").join(d.filter("period = 'pretest' and mcc is not null").select("customer_id", "mcc").distinct(), ["customer_id", "mcc"]).select("event_id")
    assert q["e15_pretest_anomaly_all"](spark, sf).join(known, "event_id").filter("pt_mcc_novel = 1").isEmpty() and not known.isEmpty()
    own = d.filter("period = 'test'").select("event_id", F.round(F.col("amt") / (F.col("amt") + 50), 6).alias("own"))
    assert q["s12_template_all"](spark, sf).join(own, "event_id").filter("own is not null and predict <> own").isEmpty()


def test_hashes_of_large_ids(spark):
    ids = [0, 1, -1, 4_000_000_000, 2**32 + 5, 2**62, -(2**62), 2**63 - 1]
    d = spark.createDataFrame([(i,) for i in ids], "event_id long").withColumn("date", F.lit("2024-03-01").cast("date"))
    got = {r["event_id"]: (r["h"], r["d"]) for r in d.select("event_id", arith_hash(F.col("event_id")).alias("h"), day_hash(F.col("event_id"), F.col("date")).alias("d")).collect()}
    want = lambda i: (i * 2654435761 + 42 * 40503) % 2**32
    assert got == {i: (want(i), want(i * 1000 + 61)) for i in ids}
    big = spark.range(50).select((F.col("id") + 4_000_000).alias("customer_id"), F.col("id").alias("event_id"), F.lit("2024-03-01").cast("date").alias("date"), F.lit(None).cast("int").alias("y"))
    assert sampling.one_day_each(big).count() == 50 and sampling.full_days(big, "y", 1.0).count() == 0
