"""Trailing windows, novelty, sessions, running aggregates and ranks (inventory W)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND, SPANS, avg_rank, clip_lo, r4, r6
from tidemark.operators import windows as O
from tidemark.registry import query
from tidemark.sources.views import SC, TX, TXO, scored, tx, tx_orders

_FRAME = "OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN {} PRECEDING AND 1 PRECEDING)"
_VELOCITY = ", ".join(f"(count(*) {_FRAME.format(s)})::INT AS cnt_{k}, sum(amt) {_FRAME.format(s)} AS amt_sum_{k}" for k, s in SPANS.items())
_ORD = "ORDER BY us, event_id"
#: History features of tx as a CTE h.
HIST = TX + f""", h AS (SELECT *, {_VELOCITY},
  (us - lag(us) OVER (PARTITION BY customer_id {_ORD})) / 1000000.0::DOUBLE AS secs_since_last,
  (sum(voip) {_FRAME.format(SPANS['24h'])})::BIGINT AS voip_cnt_24h,
  count(mcc) OVER (PARTITION BY customer_id {_ORD} ROWS UNBOUNDED PRECEDING) AS cum_unique_mcc_approx,
  (row_number() OVER (PARTITION BY customer_id, mcc {_ORD}) = 1 AND mcc IS NOT NULL)::INT AS is_new_mcc,
  (row_number() OVER (PARTITION BY customer_id, event_type {_ORD}) = 1)::INT AS is_new_type,
  CASE WHEN session_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY session_id {_ORD}) - 1 END::INT AS session_ops_before,
  CASE WHEN session_id IS NULL THEN 0.0 ELSE coalesce(sum(amt) OVER (PARTITION BY session_id {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) END AS session_amt_before
  FROM tx)"""


@query("w01_velocity", "W01 W02 W03 W04", HIST + " SELECT event_id, " + ", ".join(f"cnt_{k}, r4(amt_sum_{k}) AS amt_sum_{k}" for k in SPANS) + ", voip_cnt_24h FROM h")
def w01(spark, sf):
    d = tx(spark, sf)
    cols = O.velocity() | {"voip_cnt_24h": F.sum("voip").over(O.trailing(SPANS["24h"]))}
    wide = d.select("event_id", *[v.alias(k) for k, v in cols.items()])
    return wide.withColumns({f"amt_sum_{k}": r4(F.col(f"amt_sum_{k}")) for k in SPANS})


@query("w01_velocity_ties", "W01", TXO + f" SELECT event_id, (count(*) {_FRAME.format(SPANS['30d'])})::INT AS cnt_30d, r4(sum(amt) {_FRAME.format(SPANS['30d'])}) AS amt_sum_30d FROM txo")
def w01_ties(spark, sf):
    v = O.velocity({"30d": SPANS["30d"]})
    return tx_orders(spark, sf).select("event_id", v["cnt_30d"].alias("cnt_30d"), r4(v["amt_sum_30d"]).alias("amt_sum_30d"))


@query("w05_velocity_tied_before", "W05", TXO + f""" SELECT event_id, ((count(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN {SPANS['30d']} PRECEDING AND 1 PRECEDING))
  + row_number() OVER (PARTITION BY customer_id, us ORDER BY event_id) - 1)::INT AS cnt_30d FROM txo""")
def w05(spark, sf):
    """Earlier rows of the same instant count too."""
    tied = F.row_number().over(W.partitionBy("customer_id", "us").orderBy("event_id")) - 1
    d = tx_orders(spark, sf).repartition("customer_id")
    return d.select("event_id", (F.count("*").over(O.trailing(SPANS["30d"])) + tied).cast("int").alias("cnt_30d"))


@query("w06_lag", "W06 W07", TX + f""" SELECT event_id, (us - lag(us) OVER w) / 1000000.0::DOUBLE AS secs_since_last, lag(amt) OVER w AS prev_amt, lag(mcc) OVER w AS prev_mcc, lag(pos) OVER w AS prev_pos FROM tx WINDOW w AS (PARTITION BY customer_id {_ORD})""")
def w06(spark, sf):
    w = O.ordered()
    return tx(spark, sf).select("event_id", O.since_last().alias("secs_since_last"), *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("amt", "mcc", "pos")])


@query("w08_history", "W08 W09 W10", HIST + " SELECT event_id, is_new_mcc, is_new_type, cum_unique_mcc_approx, session_ops_before, r4(session_amt_before) AS session_amt_before FROM h")
def w08(spark, sf):
    h = O.history(tx(spark, sf))
    return h.select("event_id", "is_new_mcc", "is_new_type", "cum_unique_mcc_approx", "session_ops_before", r4(F.col("session_amt_before")).alias("session_amt_before"))


@query("w11_day_position", "W11", TX + f""" SELECT event_id, row_number() OVER w AS pos_in_day, r4(sum(amt) OVER w) AS cum_amt_in_day, (us - lag(us) OVER w) / 1000000.0::DOUBLE AS gap_in_day FROM tx
WINDOW w AS (PARTITION BY customer_id, date {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w11(spark, sf):
    w = O.ordered("customer_id", "date")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    return tx(spark, sf).select("event_id", F.row_number().over(w).cast("long").alias("pos_in_day"), r4(F.sum("amt").over(run)).alias("cum_amt_in_day"), ((F.col("us") - F.lag("us").over(w)) / SECOND).alias("gap_in_day"))


@query("w12_exclusive_running", "W12 W13", TX + f""", f AS (SELECT *, (row_number() OVER (PARTITION BY customer_id, mcc {_ORD}) = 1 AND mcc IS NOT NULL)::INT AS fresh FROM tx)
SELECT event_id, count(*) OVER w AS n, r4(sum(amt) OVER w) AS total, r4(sum(amt * amt) OVER w) AS squares, min(amt) OVER w AS low, max(amt) OVER w AS high, (sum(voip) OVER w)::BIGINT AS voip, (sum(hour) OVER w)::BIGINT AS hours, (sum(fresh) OVER w)::BIGINT AS n_mcc
FROM f WINDOW w AS (PARTITION BY customer_id {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w12(spark, sf):
    d = tx(spark, sf).repartition("customer_id").withColumn("fresh", O.first_seen("mcc"))
    run = O.exclusive_running({"n": ("count", F.lit(1)), "total": ("sum", F.col("amt")), "squares": ("sum", F.col("amt") * F.col("amt")), "low": ("min", F.col("amt")), "high": ("max", F.col("amt")), "voip": ("sum", F.col("voip")), "hours": ("sum", F.col("hour")), "n_mcc": ("sum", F.col("fresh"))})
    wide = d.select("event_id", *[v.alias(k) for k, v in run.items()])
    return wide.withColumns({"total": r4(F.col("total")), "squares": r4(F.col("squares"))})


#: Point-in-time profiles of the train period: the base of the pretrain period and all earlier train events.
PIT = TX + f""", b AS (SELECT customer_id, count(*) AS n, sum(amt) AS s, sum(amt * amt) AS q, min(amt) AS lo, max(amt) AS hi, max(us) AS last, sum(voip) AS v FROM tx WHERE period = 'pretrain' GROUP BY ALL),
bm AS (SELECT DISTINCT customer_id, mcc FROM tx WHERE period = 'pretrain' AND mcc IS NOT NULL), bn AS (SELECT customer_id, count(*) AS k FROM bm GROUP BY ALL),
t AS (SELECT tx.*, (bm.mcc IS NOT NULL)::INT AS in_base, (row_number() OVER (PARTITION BY tx.customer_id, tx.mcc {_ORD}) = 1 AND tx.mcc IS NOT NULL AND bm.mcc IS NULL)::INT AS fresh,
  row_number() OVER (PARTITION BY tx.customer_id, tx.mcc {_ORD}) AS occ FROM tx LEFT JOIN bm ON bm.customer_id = tx.customer_id AND bm.mcc = tx.mcc WHERE period = 'train'),
r AS (SELECT *, count(*) OVER w AS rn, sum(amt) OVER w AS rs, sum(amt * amt) OVER w AS rq, min(amt) OVER w AS rlo, max(amt) OVER w AS rhi, sum(voip) OVER w AS rv, sum(fresh) OVER w AS rm, lag(us) OVER (PARTITION BY customer_id {_ORD}) AS prev
  FROM t WINDOW w AS (PARTITION BY customer_id {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT r.*, coalesce(n, 0) + rn AS pit_n, coalesce(s, 0) + coalesce(rs, 0) AS pit_sum, coalesce(q, 0) + coalesce(rq, 0) AS pit_sq, least(lo, rlo) AS pit_min, greatest(hi, rhi) AS pit_max,
  coalesce(v, 0) + coalesce(rv, 0) AS pit_voip, coalesce(k, 0) + coalesce(rm, 0) AS pit_n_mcc, CASE WHEN prev IS NOT NULL THEN (us - prev) / 86400000000.0::DOUBLE WHEN last IS NOT NULL THEN (us - last) / 86400000000.0::DOUBLE ELSE 0.0 END AS dormancy,
  (r.mcc IS NOT NULL AND in_base = 0 AND occ = 1)::INT AS novel FROM r LEFT JOIN b ON b.customer_id = r.customer_id LEFT JOIN bn ON bn.customer_id = r.customer_id),
m AS (SELECT *, pit_sum / greatest(pit_n, 1) AS mean FROM p), pit AS (SELECT *, sqrt(greatest(pit_sq / greatest(pit_n, 1) - mean * mean, 0.0)) AS std FROM m)"""


def pit(spark, sf):
    """The frame of PIT: no event sees itself or anything later."""
    d = tx(spark, sf)
    old = d.filter("period = 'pretrain'")
    base = old.groupBy("customer_id").agg(F.count("*").alias("b_n"), F.sum("amt").alias("b_s"), F.sum(F.col("amt") * F.col("amt")).alias("b_q"), F.min("amt").alias("b_lo"), F.max("amt").alias("b_hi"), F.max("us").alias("b_last"), F.sum("voip").alias("b_v"), F.countDistinct("mcc").alias("b_k"))
    known = old.filter("mcc is not null").groupBy("customer_id", "mcc").agg(F.lit(1).alias("in_base"))
    t = d.filter("period = 'train'").join(known, ["customer_id", "mcc"], "left").join(base, "customer_id", "left").repartition("customer_id")
    fresh = ((O.first_seen("mcc") == 1) & F.col("in_base").isNull()).cast("int")
    t = t.withColumn("novel", fresh)
    run = O.exclusive_running({"rn": ("count", F.lit(1)), "rs": ("sum", F.col("amt")), "rq": ("sum", F.col("amt") * F.col("amt")), "rlo": ("min", F.col("amt")), "rhi": ("max", F.col("amt")), "rv": ("sum", F.col("voip")), "rm": ("sum", F.col("novel"))})
    t = t.withColumns(run | {"prev": F.lag("us").over(O.ordered()), "occ": F.row_number().over(O.ordered("customer_id", "mcc"))})
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = t.withColumns({"pit_n": z("b_n") + F.col("rn"), "pit_sum": z("b_s") + z("rs"), "pit_sq": z("b_q") + z("rq"), "pit_min": F.least("b_lo", "rlo"), "pit_max": F.greatest("b_hi", "rhi"), "pit_voip": z("b_v") + z("rv"), "pit_n_mcc": z("b_k") + z("rm"), "dormancy": (F.col("us") - F.coalesce("prev", "b_last", "us")) / (86400 * SECOND)})
    mean = F.col("pit_sum") / clip_lo(F.col("pit_n"), 1)
    return t.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("pit_sq") / clip_lo(F.col("pit_n"), 1) - F.col("mean") * F.col("mean"), F.lit(0.0))))


@query("w14_point_in_time", "W14 W15 W20 P09 P10 P11", PIT + """ SELECT event_id, pit_n::BIGINT AS pit_n, r4(pit_sum) AS pit_sum, pit_min, pit_max, pit_voip::BIGINT AS pit_voip, pit_n_mcc::BIGINT AS pit_n_mcc, r6(dormancy) AS dormancy, novel, r4(mean) AS mean, r4(std) AS std,
 r4(mean + 1.645 * std) AS p95, r4(mean + 2.326 * std) AS p99, r4(1.35 * std) AS iqr FROM pit""")
def w14(spark, sf):
    p = pit(spark, sf)
    std, mean = F.col("std"), F.col("mean")
    return p.select("event_id", "pit_n", r4(F.col("pit_sum")).alias("pit_sum"), "pit_min", "pit_max", "pit_voip", "pit_n_mcc", r6(F.col("dormancy")).alias("dormancy"), "novel", r4(mean).alias("mean"), r4(std).alias("std"), r4(mean + 1.645 * std).alias("p95"), r4(mean + 2.326 * std).alias("p99"), r4(1.35 * std).alias("iqr"))


@query("w16_entity_scores", "W16 W17", SC + """, g AS (SELECT customer_id, max(s3) AS hi, avg(s3) AS mean, coalesce(stddev_pop(s3), 0) AS std, min(s3) AS lo, max(s3) - min(s3) AS rng, quantile_cont(s3, 0.9) AS p90, count(*) AS n FROM sc GROUP BY ALL)
SELECT event_id, r6(hi) AS cust_max, r6(mean) AS cust_mean, r6(std) AS cust_std, r6(lo) AS cust_min, r6(rng) AS cust_range, r6(CASE WHEN n < 10 THEN hi ELSE p90 END) AS cust_p90, n AS cust_n,
 (row_number() OVER (PARTITION BY sc.customer_id ORDER BY s3 DESC, event_id) - 1)::INT AS rank, r6((row_number() OVER (PARTITION BY sc.customer_id ORDER BY s3 DESC, event_id) - 1)::DOUBLE / greatest(n - 1, 1)) AS rank_pct FROM sc JOIN g ON g.customer_id = sc.customer_id""")
def w16(spark, sf):
    d = scored(spark, sf)
    w = W.partitionBy("customer_id")
    rank, pct = O.group_rank("s3")
    n = F.count("*").over(w)
    hi, lo = F.max("s3").over(w), F.min("s3").over(w)
    p90 = F.when(n < 10, hi).otherwise(F.percentile("s3", F.lit(0.9)).over(w))
    return d.select("event_id", r6(hi).alias("cust_max"), r6(F.avg("s3").over(w)).alias("cust_mean"), r6(F.stddev_pop("s3").over(w)).alias("cust_std"), r6(lo).alias("cust_min"), r6(hi - lo).alias("cust_range"), r6(p90).alias("cust_p90"), n.alias("cust_n"), rank.cast("int").alias("rank"), r6(pct).alias("rank_pct"))


@query("w18_average_ranks", "W18 W19", SC + """, k AS (SELECT event_id, customer_id, round(s1, 2) AS s FROM sc)
SELECT event_id, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rank_all, r6((rank() OVER (PARTITION BY customer_id ORDER BY s) + (count(*) OVER (PARTITION BY customer_id, s) - 1) / 2.0) / count(*) OVER (PARTITION BY customer_id)) AS rank_own FROM k""")
def w18(spark, sf):
    from tidemark.operators.scoring import global_average_rank

    d = scored(spark, sf).select("event_id", "customer_id", F.round("s1", 2).alias("s"))
    d = global_average_rank(d, "s", "rank_all")
    return d.select("event_id", "rank_all", r6(avg_rank(F.col("s"), "customer_id") / F.count("*").over(W.partitionBy("customer_id"))).alias("rank_own"))
