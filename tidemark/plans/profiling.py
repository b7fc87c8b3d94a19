"""Entity profiles and aggregates (inventory P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND, r4, r6
from tidemark.operators import profiles as P
from tidemark.operators.scoring import quantiles
from tidemark.registry import query
from tidemark.sources.views import TX, TXO, tx, tx_orders

_SPAN = "(max(us) - min(us)) / 1000000.0::DOUBLE"


def basic_sql(source: str, risky: str = "(12, 15, 10, 6, 3)", night: str = "hour < 6") -> str:
    return f"""SELECT customer_id, avg(amt) AS cust_avg_amt, coalesce(stddev_samp(amt), 0) AS cust_std_amt, median(amt) AS cust_med_amt, max(amt) AS cust_max_amt, quantile_cont(amt, 0.95) AS cust_p95_amt,
  count(*) AS cust_n_tx, (count(DISTINCT mcc) + max((mcc IS NULL)::INT))::BIGINT AS cust_n_unique_mcc, count(DISTINCT event_type) AS cust_n_unique_channel, avg(hour) AS cust_avg_hour, coalesce(stddev_samp(hour), 0) AS cust_hour_std,
  avg(({night})::INT::DOUBLE) AS cust_pct_night, coalesce(avg((mcc IN {risky})::INT::DOUBLE), 0) AS cust_pct_high_risk, {_SPAN} / 86400 AS cust_tenure_days, {_SPAN} / greatest(count(*) - 1, 1) AS cust_avg_gap_sec, max(us) / 1000000.0::DOUBLE AS cust_last_epoch
  FROM {source} GROUP BY customer_id"""


BASIC_FLOATS = ("cust_avg_amt", "cust_std_amt", "cust_med_amt", "cust_p95_amt", "cust_avg_hour", "cust_hour_std", "cust_pct_night", "cust_pct_high_risk", "cust_tenure_days", "cust_avg_gap_sec", "cust_last_epoch")


def rounded(df, floats):
    return df.withColumns({c: r4(F.col(c)) for c in floats})


def replaced(floats) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"r4({c}) AS {c}" for c in floats) + ")"


_Q = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def deep_sql(source: str) -> str:
    """CTEs that end in ``prof``: the main block of the deep profile with its rates."""
    return f"""g AS (SELECT customer_id, avg(amt) AS prof_amt_mean, stddev_samp(amt) AS prof_amt_std, min(amt) AS prof_amt_min, max(amt) AS prof_amt_max, avg(hour) AS prof_hour_mean, stddev_samp(hour) AS prof_hour_std,
  avg((hour >= 22 OR hour < 6)::INT::DOUBLE) AS prof_pct_night, avg((weekday >= 6)::INT::DOUBLE) AS prof_pct_weekend, count(*) AS prof_n_tx, (count(DISTINCT mcc) + max((mcc IS NULL)::INT))::BIGINT AS prof_n_mcc,
  (count(DISTINCT session_id) + max((session_id IS NULL)::INT))::BIGINT AS prof_n_sessions, count(DISTINCT date) AS prof_active_days, sum(voip)::BIGINT AS prof_voip, {', '.join(f'quantile_cont(amt, {v}) AS prof_amt_{k}' for k, v in _Q.items())} FROM {source} GROUP BY customer_id),
prof AS (SELECT *, prof_amt_p75 - prof_amt_p25 AS prof_amt_iqr, prof_n_tx::DOUBLE / greatest(prof_active_days, 1) AS prof_tx_per_day, prof_amt_std / CASE WHEN prof_amt_mean < 0.01 THEN 0.01 ELSE prof_amt_mean END AS prof_amt_cv, prof_voip::DOUBLE / prof_n_tx AS prof_voip_rate FROM g)"""


DEEP_FLOATS = ("prof_amt_mean", "prof_amt_std", *[f"prof_amt_{k}" for k in _Q], "prof_hour_mean", "prof_hour_std", "prof_pct_night", "prof_pct_weekend", "prof_amt_iqr", "prof_tx_per_day", "prof_amt_cv", "prof_voip_rate")


@query("p01_basic_profile", "P01", TX + ", p AS (" + basic_sql("tx") + ") " + replaced(BASIC_FLOATS) + " FROM p")
def p01(spark, sf):
    return rounded(P.basic(tx(spark, sf)), BASIC_FLOATS)


@query("p02_deep_profile", "P02 P03 P12 P13", TX + ", " + deep_sql("tx") + replaced(DEEP_FLOATS) + " FROM prof")
def p02(spark, sf):
    return rounded(P.deep_main(tx(spark, sf)), DEEP_FLOATS)


_GAP = "SELECT customer_id, median(gap) AS prof_gap_median, avg(gap) AS prof_gap_mean, stddev_samp(gap) AS prof_gap_std, quantile_cont(gap, 0.95) AS prof_gap_p95 FROM (SELECT customer_id, (us - lag(us) OVER (PARTITION BY customer_id ORDER BY us, event_id)) // 1000000 AS gap FROM tx) GROUP BY customer_id"
_ENTROPY = "SELECT customer_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM (SELECT customer_id, {0}, count(*) AS n FROM tx GROUP BY ALL) GROUP BY customer_id"
_WHOLE_FLOATS = (*DEEP_FLOATS, "prof_hour_entropy", "prof_mcc_entropy", "prof_gap_median", "prof_gap_mean", "prof_gap_std", "prof_gap_p95", "daily_mean", "daily_std", "daily_median", "daily_p95")


@query("p02_deep_whole", "P02 P04 P06 P07 P08 J10", TX + ", " + deep_sql("tx") + f""", eh AS ({_ENTROPY.format('hour')}), em AS ({_ENTROPY.format('mcc')}), gp AS ({_GAP}),
mo AS (SELECT customer_id, mcc, n FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, mcc) AS k FROM (SELECT customer_id, mcc, count(*) AS n FROM tx WHERE mcc IS NOT NULL GROUP BY ALL)) WHERE k = 1),
dy AS (SELECT customer_id, avg(n) AS daily_mean, stddev_samp(n) AS daily_std, median(n) AS daily_median, max(n) AS daily_max, quantile_cont(n, 0.95) AS daily_p95, count(*) AS n_active_days FROM (SELECT customer_id, date, count(*) AS n FROM tx GROUP BY ALL) GROUP BY customer_id),
w AS (SELECT prof.*, eh.e AS prof_hour_entropy, em.e AS prof_mcc_entropy, mo.mcc AS prof_top_mcc, mo.n AS prof_top_mcc_n, gp.* EXCLUDE (customer_id), dy.* EXCLUDE (customer_id) FROM prof LEFT JOIN eh ON eh.customer_id = prof.customer_id LEFT JOIN em ON em.customer_id = prof.customer_id LEFT JOIN mo ON mo.customer_id = prof.customer_id LEFT JOIN gp ON gp.customer_id = prof.customer_id LEFT JOIN dy ON dy.customer_id = prof.customer_id) """ + replaced(_WHOLE_FLOATS) + " FROM w")
def p02_whole(spark, sf):
    """The deep profile with entropies, mode, gaps and daily pattern."""
    return rounded(P.deep(tx(spark, sf)), _WHOLE_FLOATS)


@query("p04_daily", "P04", TX + ", d AS (SELECT customer_id, date, count(*) AS n FROM tx GROUP BY ALL) SELECT customer_id, r4(avg(n)) AS daily_mean, r4(stddev_samp(n)) AS daily_std, r4(median(n)) AS daily_median, max(n) AS daily_max, r4(quantile_cont(n, 0.95)) AS daily_p95, count(*) AS n_active_days FROM d GROUP BY customer_id")
def p04(spark, sf):
    return rounded(P.daily(tx(spark, sf)), ("daily_mean", "daily_std", "daily_median", "daily_p95"))


@query("p05_mcc_profile", "P05", TX + " SELECT customer_id, mcc, r4(avg(amt)) AS mcc_amt_mean, count(*) AS mcc_n FROM tx WHERE mcc IS NOT NULL GROUP BY ALL")
def p05(spark, sf):
    return rounded(P.by_mcc(tx(spark, sf)), ("mcc_amt_mean",))


@query("p06_entropy", "P06", TX + """, a AS (SELECT customer_id, hour, count(*) AS n FROM tx GROUP BY ALL), b AS (SELECT customer_id, mcc, count(*) AS n FROM tx GROUP BY ALL),
ea AS (SELECT customer_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM a GROUP BY ALL), eb AS (SELECT customer_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM b GROUP BY ALL)
SELECT ea.customer_id, r4(ea.e) AS prof_hour_entropy, r4(eb.e) AS prof_mcc_entropy FROM ea JOIN eb ON ea.customer_id = eb.customer_id""")
def p06(spark, sf):
    d = tx(spark, sf)
    return rounded(P.entropy(d, "hour").join(P.entropy(d, "mcc"), "customer_id"), ("prof_hour_entropy", "prof_mcc_entropy"))


@query("p07_mode", "P07", TX + ", c AS (SELECT customer_id, mcc, count(*) AS n FROM tx WHERE mcc IS NOT NULL GROUP BY ALL) SELECT customer_id, mcc AS prof_top_mcc, n AS prof_top_mcc_n FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, mcc) AS k FROM c) WHERE k = 1")
def p07(spark, sf):
    return P.mode(tx(spark, sf), "mcc")


@query("p08_gaps", "P08", TX + ", g AS (SELECT customer_id, (us - lag(us) OVER (PARTITION BY customer_id ORDER BY us, event_id)) // 1000000 AS gap FROM tx) SELECT customer_id, r4(median(gap)) AS prof_gap_median, r4(avg(gap)) AS prof_gap_mean, r4(stddev_samp(gap)) AS prof_gap_std, r4(quantile_cont(gap, 0.95)) AS prof_gap_p95 FROM g GROUP BY customer_id")
def p08(spark, sf):
    return rounded(P.gaps(tx(spark, sf)), ("prof_gap_median", "prof_gap_mean", "prof_gap_std", "prof_gap_p95"))


@query("p10_moments", "P10 P11", TXO + """, m AS (SELECT customer_id, count(*) AS n, avg(amt) AS mean, coalesce(stddev_pop(amt), 0) AS std FROM txo GROUP BY ALL)
SELECT customer_id, n, r4(mean) AS mean, round(std, 1) AS std, round(mean + 1.645 * std, 1) AS p95, round(mean + 2.326 * std, 1) AS p99, round(1.35 * std, 1) AS iqr, r4(mean) AS median FROM m""")
def p10(spark, sf):
    g = tx_orders(spark, sf).groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("amt").alias("s"), F.sum(F.col("amt") * F.col("amt")).alias("q"))
    m = P.from_moments(F.col("n"), F.col("s"), F.col("q"))
    # sums of squares lose digits against a two-pass deviation: one decimal is compared
    return g.select("customer_id", "n", *[(r4(v) if k in ("mean", "median") else F.round(v, 1)).alias(k) for k, v in m.items()])


@query("p15_window_profile", "P15", TX + ", w AS (SELECT * FROM tx WHERE period = 'pretest'), p AS (" + basic_sql("w", "(3, 7, 8)", "hour BETWEEN 0 AND 6") + ") " + replaced(BASIC_FLOATS) + " FROM p")
def p15(spark, sf):
    d = tx(spark, sf).filter("period = 'pretest'")
    return rounded(P.basic(d, risky=(3, 7, 8), night=F.col("hour").between(0, 6)), BASIC_FLOATS)


@query("p15_as_of_profile", "P01 P15 C08", TX + ", w AS (SELECT * FROM tx WHERE us < 1705795200000000), p AS (" + basic_sql("w") + ") " + replaced(BASIC_FLOATS) + " FROM p")
def p15_as_of(spark, sf):
    """Leakage-free: nothing from 21 January on."""
    return rounded(P.basic(tx(spark, sf), as_of=F.lit(1705795200 * SECOND)), BASIC_FLOATS)


DAY_SQL = "SELECT customer_id, date, count(*) AS day_n_ops, sum(amt) AS day_total_amt, max(amt) AS day_max_amt, avg(amt) AS day_mean_amt, (count(DISTINCT mcc) + max((mcc IS NULL)::INT))::BIGINT AS day_n_mcc, (count(DISTINCT session_id) + max((session_id IS NULL)::INT))::BIGINT AS day_n_sessions, (max(us) - min(us)) / 1000000.0::DOUBLE AS day_span_sec FROM tx GROUP BY ALL"
DAY_FLOATS = ("day_total_amt", "day_mean_amt", "day_span_sec")


@query("p16_day_stats", "P16", TX + f", d AS ({DAY_SQL}) " + replaced(DAY_FLOATS) + " FROM d")
def p16(spark, sf):
    return rounded(P.day_stats(tx(spark, sf)), DAY_FLOATS)


@query("p17_reputation", "P17 J13", TX + """, l AS (SELECT * FROM tx WHERE target IS NOT NULL), m AS (SELECT avg(target) AS mu FROM l)
SELECT mcc, count(*) AS n, sum(target)::BIGINT AS n_fraud, r6(avg(target)) AS rate, r6(avg(target) / (any_value(mu) + 1e-6)) AS lift, r6((sum(target) + 10 * any_value(mu)) / (count(*) + 10)) AS smooth FROM l, m GROUP BY mcc""")
def p17(spark, sf):
    d = tx(spark, sf).filter("target is not null").withColumn("y", F.col("target"))
    return P.reputation(d, "mcc").select("mcc", "n", "n_fraud", *[r6(F.col(c)).alias(c) for c in ("rate", "lift", "smooth")])


_TWO = TX + ", o AS (SELECT * FROM tx WHERE period = 'pretrain'), w AS (SELECT * FROM tx WHERE period = 'pretest'), old AS (WITH " + deep_sql("o") + " SELECT * FROM prof), new AS (WITH " + deep_sql("w") + " SELECT * FROM prof)"
_BLEND = ("prof_amt_mean", "prof_amt_std", "prof_amt_median", "prof_hour_mean", "prof_tx_per_day")


def old_and_new(spark, sf):
    d = tx(spark, sf)
    return P.deep_main(d.filter("period = 'pretrain'")), P.deep_main(d.filter("period = 'pretest'"))


@query("p18_blend", "P18 J01", _TWO + ", a AS (SELECT old.*, new.prof_n_tx AS nn, least(new.prof_n_tx / 200.0::DOUBLE, 0.6::DOUBLE) AS a, " + ", ".join(f"new.{c} AS n_{c}" for c in _BLEND) + " FROM old LEFT JOIN new ON new.customer_id = old.customer_id) SELECT customer_id, " + ", ".join(f"r4(CASE WHEN n_{c} IS NULL OR nn IS NULL THEN {c} ELSE a * n_{c} + (1 - a) * {c} END) AS {c}" for c in _BLEND) + " FROM a")
def p18(spark, sf):
    return rounded(P.blended(*old_and_new(spark, sf), _BLEND), _BLEND)


@query("p19_hybrid", "P19 U01 J07", _TWO + """ SELECT customer_id, prof_n_tx, r4(prof_amt_mean) AS prof_amt_mean FROM new WHERE prof_n_tx >= 10
UNION ALL SELECT customer_id, prof_n_tx, r4(prof_amt_mean) FROM old WHERE customer_id NOT IN (SELECT customer_id FROM new WHERE prof_n_tx >= 10)""")
def p19(spark, sf):
    return P.hybrid(*old_and_new(spark, sf)).select("customer_id", "prof_n_tx", r4(F.col("prof_amt_mean")).alias("prof_amt_mean"))


@query("p20_drift", "P20 J04 J11", _TWO + """, d AS (SELECT new.customer_id, new.prof_amt_mean / greatest(old.prof_amt_mean, 1.0) AS a, new.prof_tx_per_day / greatest(old.prof_tx_per_day, 0.1) AS f, least(abs(new.prof_hour_mean - old.prof_hour_mean), 12) AS h FROM new JOIN old ON old.customer_id = new.customer_id)
SELECT tx.event_id, r4(coalesce(a, 1.0)) AS drift_amt, r4(coalesce(f, 1.0)) AS drift_freq, r4(coalesce(h, 0.0)) AS drift_hour FROM tx LEFT JOIN d ON d.customer_id = tx.customer_id WHERE period = 'test'""")
def p20(spark, sf):
    d = P.drift(*old_and_new(spark, sf))
    e = tx(spark, sf).filter("period = 'test'").join(d, "customer_id", "left")
    return e.select("event_id", *[r4(F.coalesce(c, F.lit(v))).alias(c) for c, v in (("drift_amt", 1.0), ("drift_freq", 1.0), ("drift_hour", 0.0))])


@query("p21_rollup", "P21", TX + """, s AS (SELECT hour, weekday, day(event_dttm) // 10 AS decade, target FROM tx)
SELECT 'decade' AS part, decade::INT AS value, count(*) AS n, coalesce(sum(target), 0)::BIGINT AS fraud, r6(coalesce(sum(target), 0)::DOUBLE / count(*)) AS rate FROM s GROUP BY decade
UNION ALL SELECT 'hour', hour, count(*), coalesce(sum(target), 0)::BIGINT, r6(coalesce(sum(target), 0)::DOUBLE / count(*)) FROM s GROUP BY hour UNION ALL SELECT 'weekday', weekday, count(*), coalesce(sum(target), 0)::BIGINT, r6(coalesce(sum(target), 0)::DOUBLE / count(*)) FROM s GROUP BY weekday""")
def p21(spark, sf):
    """Three groupings from one scan and one shuffle."""
    d = tx(spark, sf).select("hour", "weekday", F.floor(F.dayofmonth("event_dttm") / 10).cast("int").alias("decade"), "target")
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("value")) for c in ("decade", "hour", "weekday")]))
    n, fraud = F.count("*"), F.coalesce(F.sum("target"), F.lit(0))
    return d.select("target", parts.alias("p")).groupBy("p.part", "p.value").agg(n.alias("n"), fraud.alias("fraud"), r6(fraud / n).alias("rate"))


@query("p22_value_counts", "P22 P25", TX + ", c AS (SELECT CASE target WHEN 1 THEN 'fraud' WHEN 0 THEN 'confirmed' ELSE 'green' END AS class FROM tx) SELECT class, count(*) AS n, r6(100.0 * count(*) / (SELECT count(*) FROM c)) AS pct FROM c GROUP BY class")
def p22(spark, sf):
    cls = F.when(F.col("target") == 1, "fraud").when(F.col("target") == 0, "confirmed").otherwise("green")
    g = tx(spark, sf).select(cls.alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("class", "n", r6(100.0 * F.col("n") / F.col("total")).alias("pct"))


@query("p23_scalars", "P23", TX + " SELECT r4(avg(amt)) AS mean, count(*) AS n, count_if(mcc IS NULL)::BIGINT AS n_null_mcc, r4(quantile_cont(amt, 0.95)) AS p95, r4(stddev_samp(amt)) AS std FROM tx")
def p23(spark, sf):
    d = tx(spark, sf)
    g = d.agg(r4(F.avg("amt")).alias("mean"), F.count("*").alias("n"), F.count_if(F.col("mcc").isNull()).alias("n_null_mcc"), r4(F.stddev("amt")).alias("std"))
    return g.crossJoin(quantiles(d, "amt", {"p95": 0.95})).select("mean", "n", "n_null_mcc", r4(F.col("p95")).alias("p95"), "std")
