"""Feature projections over history and profiles (inventory E, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND, clip_lo, flag, nz, r4, r6
from tidemark.operators import features as X
from tidemark.operators import graph
from tidemark.operators import profiles as P
from tidemark.operators import windows as O
from tidemark.plans.profiling import basic_sql, deep_sql
from tidemark.plans.windowing import HIST, PIT, pit
from tidemark.registry import query
from tidemark.sources.views import TX, table, tx


def out(df, key="event_id"):
    """All computed columns, floats rounded."""
    return df.select(key, *[(r4(F.col(c)) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes if c != key])


@query("e01_base", "E01 E02 E06", TX + """ SELECT event_id, hour, weekday, month(event_dttm)::INT AS month, (hour < 6)::INT AS is_night, r4(ln(1 + amt)) AS log_amount, (amt IS NULL)::INT AS is_null_amount, voip + (hour < 6)::INT AS security_flags_sum,
 (mcc IS NULL)::INT AS is_null_mcc, (coalesce(mcc, -1) IN (12, 15, 10, 6, 3))::INT AS is_high_risk_type, (session_id IS NULL)::INT AS is_null_session, coalesce(pos = 1, false)::INT AS is_pos_1, coalesce(mcc, -1) AS mcc FROM tx""")
def e01(spark, sf):
    return out(X.base(tx(spark, sf)))


def _ratios_sql() -> str:
    pairs = (("1h", "24h"), ("24h", "7d"), ("7d", "30d"))
    c = [f"r4(cnt_{a}::DOUBLE / (cnt_{b} + 1)) AS cnt_ratio_{a}_{b}, r4(amt_sum_{a} / (abs(amt_sum_{b}) + 1)) AS amt_ratio_{a}_{b}" for a, b in pairs]
    c += [f"r4(amt / (abs(amt_sum_{w}) + 1)) AS amt_cur_ratio_{w}" for w in ("24h", "7d", "30d")]
    return ", ".join(c)


@query("e03_velocity_ratios", "E03", HIST + f" SELECT event_id, {_ratios_sql()} FROM h")
def e03(spark, sf):
    return out(X.velocity_ratios(O.history(tx(spark, sf))))


@query("e04_rolling_deviation", "E04 E05", HIST + """, a AS (SELECT *, amt_sum_7d / (cnt_7d + 1) AS a7, amt_sum_30d / (cnt_30d + 1) AS a30 FROM h)
SELECT event_id, r4(a7) AS avg_amt_7d, r4(a30) AS avg_amt_30d, r4(amt / (a7 + 1)) AS amt_deviation_7d, r4(amt / (a30 + 1)) AS amt_deviation_30d, r4(amt - a30) AS amt_diff_30d, r4(amt / (amt_sum_30d + 1)) AS amt_pct_of_30d,
 coalesce(secs_since_last < 60, false)::INT AS is_fast_60s, coalesce(secs_since_last < 120, false)::INT AS is_fast_120s, coalesce(secs_since_last < 300, false)::INT AS is_fast_300s, (cnt_1h > 3)::INT AS burst_3, (cnt_1h > 5)::INT AS burst_5, (cnt_6h > 10)::INT AS burst_6h,
 r4(cnt_1h / (cnt_24h / 24.0::DOUBLE + 0.01::DOUBLE)) AS hourly_activity_ratio, r4(ln(1 + secs_since_last)) AS log_secs, (session_ops_before = 0)::INT AS is_first_in_session, r4(ln(1 + cnt_30d)) AS log_cnt_30d FROM a""")
def e04(spark, sf):
    return out(X.rolling_deviation(O.history(tx(spark, sf))))


_DEV = """ SELECT event_id, r4(coalesce((amt - cust_avg_amt) / (cust_std_amt + 1), 0)) AS amt_zscore, r4(coalesce(amt / (cust_med_amt + 1), 0)) AS amt_vs_median, r4(coalesce((us / 1000000.0::DOUBLE - cust_last_epoch) / 86400, 0)) AS dormancy_days,
 r4(coalesce(abs(hour - cust_avg_hour), 0)) AS hour_deviation, r4(coalesce(cnt_30d / (2592000 / (cust_avg_gap_sec + 1) + 0.01::DOUBLE), 0)) AS freq_vs_historical, r4(coalesce(amt / (cust_max_amt + 1), 0)) AS amt_vs_max, r4(coalesce(amt / (cust_p95_amt + 1), 0)) AS amt_vs_p95,
 (coalesce(abs((amt - cust_avg_amt) / (cust_std_amt + 1)), 0) > 3)::INT AS is_amt_outlier, (coalesce(abs((amt - cust_avg_amt) / (cust_std_amt + 1)), 0) > 2)::INT AS is_amt_unusual, (coalesce((us / 1000000.0::DOUBLE - cust_last_epoch) / 86400, 0) > 5)::INT AS is_dormant, (p.customer_id IS NULL)::INT AS is_new_customer
 FROM h LEFT JOIN p ON p.customer_id = h.customer_id WHERE period = 'test'"""


@query("e07_customer_deviation", "E07 E08 J01", HIST + ", o AS (SELECT * FROM tx WHERE period = 'pretrain'), p AS (" + basic_sql("o") + ")" + _DEV)
def e07(spark, sf):
    d = tx(spark, sf)
    h = O.history(d).filter("period = 'test'")
    return out(X.customer_deviation(h, P.basic(d.filter("period = 'pretrain'")), dormant_days=5))


_ANOM = """ SELECT event_id, r4((amt - prof_amt_mean) / sd) AS anom_amt_zscore, r4(amt / CASE WHEN prof_amt_median < 1 THEN 1 ELSE prof_amt_median END) AS anom_amt_vs_median, r4(amt / CASE WHEN prof_amt_p95 < 1 THEN 1 ELSE prof_amt_p95 END) AS anom_amt_vs_p95, r4(amt / CASE WHEN prof_amt_p99 < 1 THEN 1 ELSE prof_amt_p99 END) AS anom_amt_vs_p99,
 (amt > prof_amt_max)::INT AS anom_amt_above_max, (amt < prof_amt_min)::INT AS anom_amt_below_min, r4((amt - prof_amt_median) / CASE WHEN prof_amt_iqr < 1 THEN 1 ELSE prof_amt_iqr END) AS anom_amt_iqr_score,
 r4(CASE WHEN abs(hour - prof_hour_mean) > 12 THEN 12 ELSE abs(hour - prof_hour_mean) END / CASE WHEN prof_hour_std < 0.1 THEN 0.1::DOUBLE ELSE prof_hour_std END) AS anom_hour_zscore, r4((hour >= 22 OR hour < 6)::INT * (1 - prof_pct_night)) AS anom_night_unusual, r4((weekday >= 6)::INT * (1 - prof_pct_weekend)) AS anom_weekend_unusual,
 (mcc_n IS NULL)::INT AS anom_mcc_novel, r4(ln(1 + coalesce(mcc_n, 0))) AS anom_mcc_familiarity, r4((amt - coalesce(mcc_amt_mean, prof_amt_mean)) / sd) AS anom_amt_vs_mcc_typical, r4(coalesce(mcc_n, 0)::DOUBLE / greatest(prof_n_tx, 1)) AS anom_mcc_share,
 r4((secs_since_last - coalesce(prof_gap_mean, 3600)) / CASE WHEN coalesce(prof_gap_std, 7200) < 60 THEN 60 ELSE coalesce(prof_gap_std, 7200) END) AS anom_gap_zscore, r4(secs_since_last / CASE WHEN coalesce(prof_gap_median, 3600) < 60 THEN 60 ELSE coalesce(prof_gap_median, 3600) END) AS anom_gap_vs_median,
 r4(cnt_24h / CASE WHEN coalesce(prof_tx_per_day, 5) < 0.5 THEN 0.5::DOUBLE ELSE coalesce(prof_tx_per_day, 5) END) AS anom_daily_velocity, r4(cnt_1h / CASE WHEN coalesce(prof_tx_per_day, 5) / 24 < 0.01 THEN 0.01::DOUBLE ELSE coalesce(prof_tx_per_day, 5) / 24 END) AS anom_hourly_burst
 FROM (SELECT h.*, prof.* EXCLUDE (customer_id), mp.mcc_n, mp.mcc_amt_mean, gp.* EXCLUDE (customer_id), CASE WHEN prof_amt_std < 1 THEN 1 ELSE prof_amt_std END AS sd FROM h LEFT JOIN prof ON prof.customer_id = h.customer_id LEFT JOIN mp ON mp.customer_id = h.customer_id AND mp.mcc = h.mcc LEFT JOIN gp ON gp.customer_id = h.customer_id)
 WHERE period IN ('train', 'pretest', 'test')"""
_PROFILES = ", o AS (SELECT * FROM tx WHERE period = 'pretrain'), " + deep_sql("o") + ", mp AS (SELECT customer_id, mcc, avg(amt) AS mcc_amt_mean, count(*) AS mcc_n FROM o WHERE mcc IS NOT NULL GROUP BY ALL), gg AS (SELECT customer_id, (us - lag(us) OVER (PARTITION BY customer_id ORDER BY us, event_id)) // 1000000 AS gap FROM o), gp AS (SELECT customer_id, median(gap) AS prof_gap_median, avg(gap) AS prof_gap_mean, stddev_samp(gap) AS prof_gap_std FROM gg GROUP BY ALL)"


@query("e09_anomaly", "E09 E10 E11 E12 E13 J02 J10", HIST + _PROFILES + _ANOM)
def e09(spark, sf):
    """The flagship: eighteen deviations of each event from the pretrain profile of its customer."""
    d = tx(spark, sf)
    old = d.filter("period = 'pretrain'")
    h = O.history(d).filter("period in ('train', 'pretest', 'test')")
    return out(X.anomalies(h, P.deep_main(old).join(P.gaps(old), "customer_id", "left"), P.by_mcc(old)))


@query("e14_pit_anomaly", "E14", PIT + """, g AS (SELECT *, (us - prev) / 1000000.0::DOUBLE AS gap FROM pit)
SELECT event_id, r4(CASE WHEN pit_n > 0 THEN (amt - mean) / greatest(std, 1) END) AS anom_amt_zscore, r4(CASE WHEN pit_n > 0 THEN amt / greatest(mean + 1.645 * std, 1) END) AS anom_amt_vs_p95, coalesce(amt > pit_max, false)::INT AS anom_amt_above_max, r4(ln(1 + occ)) AS anom_mcc_familiarity, r4(occ::DOUBLE / greatest(pit_n, 1)) AS anom_mcc_share,
 r4(coalesce((gap - 3600) / 7200, 0.0)) AS anom_gap_zscore, r4(coalesce(gap / 3600, 1.0)) AS anom_gap_ratio, r4(log2(greatest(pit_n_mcc, 1))) AS prof_mcc_entropy FROM g""")
def e14(spark, sf):
    p = pit(spark, sf)
    gap = (F.col("us") - F.col("prev")) / SECOND
    known = F.col("pit_n") > 0
    std, mean, amt = F.col("std"), F.col("mean"), F.col("amt")
    return out(p.select("event_id", F.when(known, (amt - mean) / clip_lo(std, 1.0)).alias("anom_amt_zscore"), F.when(known, amt / clip_lo(mean + 1.645 * std, 1.0)).alias("anom_amt_vs_p95"), flag(amt > F.col("pit_max")).alias("anom_amt_above_max"), F.log1p(F.col("occ").cast("double")).alias("anom_mcc_familiarity"), (F.col("occ") / clip_lo(F.col("pit_n"), 1)).alias("anom_mcc_share"), nz((gap - 3600) / 7200, 0.0).alias("anom_gap_zscore"), nz(gap / 3600, 1.0).alias("anom_gap_ratio"), F.log2(clip_lo(F.col("pit_n_mcc"), 1).cast("double")).alias("prof_mcc_entropy")))


_PT_ANOM = """, j AS (SELECT tx.*, coalesce(new.prof_amt_mean, old.prof_amt_mean) AS m, coalesce(new.prof_amt_std, old.prof_amt_std) AS s, coalesce(new.prof_amt_median, old.prof_amt_median) AS d, coalesce(new.prof_hour_mean, old.prof_hour_mean) AS hm, mp.mcc AS known FROM tx LEFT JOIN new ON new.customer_id = tx.customer_id LEFT JOIN old ON old.customer_id = tx.customer_id LEFT JOIN mp ON mp.customer_id = tx.customer_id AND mp.mcc = tx.mcc WHERE period = 'test')
SELECT event_id, r4((amt - m) / CASE WHEN s < 1 THEN 1 ELSE s END) AS pt_amt_zscore, r4(amt / CASE WHEN d < 1 THEN 1 ELSE d END) AS pt_amt_vs_median, r4(CASE WHEN abs(hour - hm) > 12 THEN 12 ELSE abs(hour - hm) END) AS pt_hour_deviation, (known IS NULL)::INT AS pt_mcc_novel FROM j"""


_PT_ALL = TX + ", o AS (SELECT * FROM tx WHERE period = 'pretrain'), w AS (SELECT * FROM tx WHERE period = 'pretest'), old AS (WITH " + deep_sql("o") + " SELECT * FROM prof), new AS (WITH " + deep_sql("w") + " SELECT * FROM prof), mp AS (SELECT DISTINCT customer_id, mcc FROM w WHERE mcc IS NOT NULL)"


@query("e15_pretest_anomaly_all", "E15 E20", _PT_ALL + _PT_ANOM)
def e15_all(spark, sf):
    """Both profiles from all rows; their fallbacks are tested on a small frame."""
    d = tx(spark, sf)
    w = d.filter("period = 'pretest'")
    return out(X.pretest_anomalies(d.filter("period = 'test'"), P.deep_main(d.filter("period = 'pretrain'")), P.deep_main(w), P.by_mcc(w)))


_EDGES = "WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000), e AS (SELECT DISTINCT l_suppkey AS device, o_custkey AS customer_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey), g AS (SELECT device, count(*) AS dev_n_customers, count(f.o_custkey) AS dev_n_fraud_customers, count(f.o_custkey)::DOUBLE / count(*) AS dev_fraud_rate FROM e LEFT JOIN f ON f.o_custkey = e.customer_id GROUP BY device)"


@query("g01_device_graph", "G01", _EDGES + " SELECT device, dev_n_customers, dev_n_fraud_customers, r6(dev_fraud_rate) AS dev_fraud_rate FROM g")
def g01(spark, sf):
    g = graph.degrees(*_graph(spark, sf))
    return g.withColumn("dev_fraud_rate", r6(F.col("dev_fraud_rate")))


def _graph(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    edges = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("device")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("device", F.col("o_custkey").alias("customer_id")).distinct()
    return edges, o.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("customer_id")).distinct()


@query("e16_device_features", "E16", _EDGES + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (dev_n_customers >= 10)::INT AS dev_is_farm, r4(ln(1 + dev_n_customers)) AS dev_log_customers, dev_n_fraud_customers FROM lineitem LEFT JOIN g ON g.device = l_suppkey")
def e16(spark, sf):
    g = graph.degrees(*_graph(spark, sf))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.join(g, F.col("l_suppkey") == F.col("device"), "left").select(*l.columns, (F.col("dev_n_customers") >= 10).cast("int").alias("dev_is_farm"), r4(F.log1p(F.col("dev_n_customers").cast("double"))).alias("dev_log_customers"), "dev_n_fraud_customers")


@query("e17_sequence", "E17", HIST + """, q AS (SELECT *, lag(amt) OVER w AS prev, lag(mcc) OVER w AS pmcc, lag(pos) OVER w AS ppos FROM h WINDOW w AS (PARTITION BY customer_id ORDER BY us, event_id))
SELECT event_id, r4(coalesce(amt / CASE WHEN prev < 1 THEN 1 ELSE prev END, 1.0)) AS seq_amt_ratio_prev, r4(amt - coalesce(prev, amt)) AS seq_amt_diff_prev, coalesce(mcc <> pmcc, false)::INT AS seq_mcc_changed, coalesce(ppos <> 1 AND pos = 1, false)::INT AS seq_pos_to_manual, coalesce(prev < 5 AND amt > 100, false)::INT AS seq_micro_then_large,
 r4(amt / (session_amt_before / greatest(session_ops_before, 1) + 1)) AS seq_vs_session, (session_ops_before = 0 AND amt > 100)::INT AS seq_large_first, r4(cnt_1h / (cnt_6h / 6.0::DOUBLE + 0.01::DOUBLE)) AS velocity_accel, r4(amt_sum_1h / (amt_sum_6h / 6 + 1)) AS spend_accel FROM q""")
def e17(spark, sf):
    return out(X.sequence(O.history(tx(spark, sf)), micro=5.0, large=100.0))


@query("e18_day_context", "E18 E19 J03 J12", TX + f""", d AS (SELECT customer_id, date, sum(amt) AS total, max(amt) AS top, count(*) AS n, min(us) AS first, sum(voip) AS sec FROM tx GROUP BY ALL), a AS (SELECT customer_id, avg(n) AS an, avg(total) AS avt FROM d GROUP BY ALL), w AS (SELECT *, row_number() OVER v AS pos_in_day, sum(amt) OVER v AS cum FROM tx WINDOW v AS (PARTITION BY customer_id, date ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, r4(amt / (total + 1)) AS amt_pct_of_day, (amt = top)::INT AS is_max_amt_day, pos_in_day::INT AS pos_in_day, r4(cum) AS cum_amt_in_day, r4(pos_in_day::DOUBLE / n) AS pct_pos_in_day, r4((us - first) / 1000000.0::DOUBLE) AS secs_since_day_start, r4(n / (an + 0.01)) AS day_ops_vs_avg, r4(total / (avt + 1)) AS day_amt_vs_avg, sec::BIGINT AS day_security_sum
FROM w JOIN d ON d.customer_id = w.customer_id AND d.date = w.date JOIN a ON a.customer_id = w.customer_id""")
def e18(spark, sf):
    return out(X.day_context(tx(spark, sf)))


@query("e21_monthly_zscore", "E21", HIST + """, s AS (SELECT day(event_dttm) // 10 AS part, avg(cnt_24h) AS m, stddev_samp(cnt_24h) AS sd, avg(amt_sum_24h) AS am, stddev_samp(amt_sum_24h) AS asd FROM h WHERE period IN ('pretrain', 'train') GROUP BY ALL), g AS (SELECT avg(cnt_24h) AS m, stddev_samp(cnt_24h) AS sd, avg(amt_sum_24h) AS am, stddev_samp(amt_sum_24h) AS asd FROM h WHERE period IN ('pretrain', 'train'))
SELECT event_id, r4((cnt_24h - coalesce(s.m, g.m)) / (coalesce(s.sd, g.sd) + 0.001::DOUBLE)) AS z_cnt_24h, r4((amt_sum_24h - coalesce(s.am, g.am)) / (coalesce(s.asd, g.asd) + 0.001::DOUBLE)) AS z_amt_sum_24h FROM h LEFT JOIN s ON s.part = day(event_dttm) // 10, g""")
def e21(spark, sf):
    h = O.history(tx(spark, sf)).withColumn("part", F.floor(F.dayofmonth("event_dttm") / 10))
    return out(X.part_zscores(h, h.filter("period in ('pretrain', 'train')"), "part", ("cnt_24h", "amt_sum_24h")))
