"""Named feature projections over history windows and profiles. Each is one select, so Catalyst fuses it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND, clip_hi, clip_lo, flag, nz

KEY = "customer_id"
RISKY = (12, 15, 10, 6, 3)


def base(d: DataFrame) -> DataFrame:
    night = (F.col("hour") < 6).cast("int")
    return d.select("event_id", "hour", "weekday", F.month("event_dttm").alias("month"), night.alias("is_night"), F.log1p("amt").alias("log_amount"), F.col("amt").isNull().cast("int").alias("is_null_amount"), (F.col("voip") + night).alias("security_flags_sum"), F.col("mcc").isNull().cast("int").alias("is_null_mcc"), nz(F.col("mcc"), -1).isin(*RISKY).cast("int").alias("is_high_risk_type"), F.col("session_id").isNull().cast("int").alias("is_null_session"), flag(F.col("pos") == 1).alias("is_pos_1"), nz(F.col("mcc"), -1).alias("mcc"))


def velocity_ratios(h: DataFrame) -> DataFrame:
    c = lambda n: F.col(n)
    cols = []
    for a, b in (("1h", "24h"), ("24h", "7d"), ("7d", "30d")):
        cols += [(c(f"cnt_{a}") / (c(f"cnt_{b}") + 1)).alias(f"cnt_ratio_{a}_{b}"), (c(f"amt_sum_{a}") / (F.abs(f"amt_sum_{b}") + 1)).alias(f"amt_ratio_{a}_{b}")]
    cols += [(c("amt") / (F.abs(f"amt_sum_{w}") + 1)).alias(f"amt_cur_ratio_{w}") for w in ("24h", "7d", "30d")]
    return h.select("event_id", *cols)


def rolling_deviation(h: DataFrame) -> DataFrame:
    a7, a30 = (F.col(f"amt_sum_{w}") / (F.col(f"cnt_{w}") + 1) for w in ("7d", "30d"))
    amt, s = F.col("amt"), F.col("secs_since_last")
    return h.select("event_id", a7.alias("avg_amt_7d"), a30.alias("avg_amt_30d"), (amt / (a7 + 1)).alias("amt_deviation_7d"), (amt / (a30 + 1)).alias("amt_deviation_30d"), (amt - a30).alias("amt_diff_30d"), F.try_divide(amt, F.col("amt_sum_30d") + 1).alias("amt_pct_of_30d"), *[flag(s < k).alias(f"is_fast_{k}s") for k in (60, 120, 300)], (F.col("cnt_1h") > 3).cast("int").alias("burst_3"), (F.col("cnt_1h") > 5).cast("int").alias("burst_5"), (F.col("cnt_6h") > 10).cast("int").alias("burst_6h"), (F.col("cnt_1h") / (F.col("cnt_24h") / 24 + 0.01)).alias("hourly_activity_ratio"), F.log1p(s).alias("log_secs"), (F.col("session_ops_before") == 0).cast("int").alias("is_first_in_session"), F.log1p(F.col("cnt_30d").cast("double")).alias("log_cnt_30d"))


def customer_deviation(h: DataFrame, profile: DataFrame, dormant_days: float = 90) -> DataFrame:
    """Deviations from the basic profile; an unknown customer has 0 everywhere and is_new_customer."""
    j = h.join(profile.withColumn("__known", F.lit(1)), KEY, "left")
    amt = F.col("amt")
    z = nz((amt - F.col("cust_avg_amt")) / (F.col("cust_std_amt") + 1), 0.0)
    idle = nz((F.col("us") / SECOND - F.col("cust_last_epoch")) / 86400, 0.0)
    over = lambda c: nz(amt / (F.col(c) + 1), 0.0)
    return j.select("event_id", z.alias("amt_zscore"), over("cust_med_amt").alias("amt_vs_median"), idle.alias("dormancy_days"), nz(F.abs(F.col("hour") - F.col("cust_avg_hour")), 0.0).alias("hour_deviation"), nz(F.col("cnt_30d") / (F.lit(2592000) / (F.col("cust_avg_gap_sec") + 1) + 0.01), 0.0).alias("freq_vs_historical"), over("cust_max_amt").alias("amt_vs_max"), over("cust_p95_amt").alias("amt_vs_p95"), (F.abs(z) > 3).cast("int").alias("is_amt_outlier"), (F.abs(z) > 2).cast("int").alias("is_amt_unusual"), (idle > dormant_days).cast("int").alias("is_dormant"), F.col("__known").isNull().cast("int").alias("is_new_customer"))


def anomalies(h: DataFrame, profile: DataFrame, mcc_profile: DataFrame) -> DataFrame:
    """Deviations from the deep profile (with its gap statistics) and from the entity's code profile."""
    j = h.join(profile, KEY, "left").join(mcc_profile, [KEY, "mcc"], "left")
    amt, hour, c = F.col("amt"), F.col("hour"), F.col
    sd, away = clip_lo(c("prof_amt_std"), 1.0), F.abs(hour - c("prof_hour_mean"))
    tpd = nz(c("prof_tx_per_day"), 5.0)
    s = c("secs_since_last")
    return j.select(
        "event_id",
        ((amt - c("prof_amt_mean")) / sd).alias("anom_amt_zscore"),
        *[(amt / clip_lo(c(f"prof_amt_{k}"), 1.0)).alias(f"anom_amt_vs_{k}") for k in ("median", "p95", "p99")],
        (amt > c("prof_amt_max")).cast("int").alias("anom_amt_above_max"),
        (amt < c("prof_amt_min")).cast("int").alias("anom_amt_below_min"),
        ((amt - c("prof_amt_median")) / clip_lo(c("prof_amt_iqr"), 1.0)).alias("anom_amt_iqr_score"),
        (clip_hi(away, 12.0) / clip_lo(c("prof_hour_std"), 0.1)).alias("anom_hour_zscore"),
        (((hour >= 22) | (hour < 6)).cast("int") * (1 - c("prof_pct_night"))).alias("anom_night_unusual"),
        ((c("weekday") >= 6).cast("int") * (1 - c("prof_pct_weekend"))).alias("anom_weekend_unusual"),
        c("mcc_n").isNull().cast("int").alias("anom_mcc_novel"),
        F.log1p(nz(c("mcc_n"), 0).cast("double")).alias("anom_mcc_familiarity"),
        ((amt - nz(c("mcc_amt_mean"), c("prof_amt_mean"))) / sd).alias("anom_amt_vs_mcc_typical"),
        (nz(c("mcc_n"), 0) / clip_lo(c("prof_n_tx"), 1)).alias("anom_mcc_share"),
        ((s - nz(c("prof_gap_mean"), 3600.0)) / clip_lo(nz(c("prof_gap_std"), 7200.0), 60.0)).alias("anom_gap_zscore"),
        (s / clip_lo(nz(c("prof_gap_median"), 3600.0), 60.0)).alias("anom_gap_vs_median"),
        (c("cnt_24h") / clip_lo(tpd, 0.5)).alias("anom_daily_velocity"),
        (c("cnt_1h") / clip_lo(tpd / 24, 0.01)).alias("anom_hourly_burst"),
    )


def pretest_anomalies(d: DataFrame, old: DataFrame, new: DataFrame, new_mcc: DataFrame) -> DataFrame:
    """Deviations from the newer profile, and from the older one of customers that it lacks."""
    keep = ("prof_amt_mean", "prof_amt_std", "prof_amt_median", "prof_hour_mean")
    o = old.select(KEY, *[F.col(c).alias(f"o_{c}") for c in keep])
    j = d.join(new.select(KEY, *keep), KEY, "left").join(o, KEY, "left").join(new_mcc.select(KEY, "mcc", "mcc_n"), [KEY, "mcc"], "left")
    m, s, md, hm = (F.coalesce(F.col(c), F.col(f"o_{c}")) for c in keep)
    return j.select("event_id", ((F.col("amt") - m) / clip_lo(s, 1.0)).alias("pt_amt_zscore"), (F.col("amt") / clip_lo(md, 1.0)).alias("pt_amt_vs_median"), clip_hi(F.abs(F.col("hour") - hm), 12.0).alias("pt_hour_deviation"), F.col("mcc_n").isNull().cast("int").alias("pt_mcc_novel"))


def sequence(h: DataFrame, micro: float = 500.0, large: float = 10000.0) -> DataFrame:
    w = W.partitionBy(KEY).orderBy("us", "event_id")
    d = h.withColumns({"prev": F.lag("amt").over(w), "pmcc": F.lag("mcc").over(w), "ppos": F.lag("pos").over(w)})
    amt, prev, ops = F.col("amt"), F.col("prev"), F.col("session_ops_before")
    return d.select("event_id", nz(amt / clip_lo(prev, 1.0), 1.0).alias("seq_amt_ratio_prev"), (amt - nz(prev, amt)).alias("seq_amt_diff_prev"), flag(F.col("mcc") != F.col("pmcc")).alias("seq_mcc_changed"), flag((F.col("ppos") != 1) & (F.col("pos") == 1)).alias("seq_pos_to_manual"), flag((prev < micro) & (amt > large)).alias("seq_micro_then_large"), (amt / (F.col("session_amt_before") / clip_lo(ops, 1) + 1)).alias("seq_vs_session"), ((ops == 0) & (amt > large)).cast("int").alias("seq_large_first"), (F.col("cnt_1h") / (F.col("cnt_6h") / 6 + 0.01)).alias("velocity_accel"), (F.col("amt_sum_1h") / (F.col("amt_sum_6h") / 6 + 1)).alias("spend_accel"))


def day_context(d: DataFrame) -> DataFrame:
    """An event within its day, and the day against the entity's days; windows on one shuffle instead of joins back."""
    day = W.partitionBy(KEY, "date")
    w = day.orderBy("us", "event_id")
    d = d.repartition(KEY).withColumns({"total": F.sum("amt").over(day), "top": F.max("amt").over(day), "n": F.count("*").over(day), "first": F.min("us").over(day), "sec": F.sum("voip").over(day), "pos_in_day": F.row_number().over(w), "cum": F.sum("amt").over(w.rowsBetween(W.unboundedPreceding, 0))})
    # means over days: the first event of each day stands for it
    one = F.col("pos_in_day") == 1
    own = W.partitionBy(KEY)
    d = d.withColumns({"an": F.avg(F.when(one, F.col("n"))).over(own), "at": F.avg(F.when(one, F.col("total"))).over(own)})
    return d.select("event_id", (F.col("amt") / (F.col("total") + 1)).alias("amt_pct_of_day"), (F.col("amt") == F.col("top")).cast("int").alias("is_max_amt_day"), "pos_in_day", F.col("cum").alias("cum_amt_in_day"), (F.col("pos_in_day") / F.col("n")).alias("pct_pos_in_day"), ((F.col("us") - F.col("first")) / SECOND).alias("secs_since_day_start"), (F.col("n") / (F.col("an") + 0.01)).alias("day_ops_vs_avg"), (F.col("total") / (F.col("at") + 1)).alias("day_amt_vs_avg"), F.col("sec").alias("day_security_sum"))


def part_zscores(d: DataFrame, train: DataFrame, part: str, cols: tuple[str, ...]) -> DataFrame:
    """Z-scores by the training rows' statistics of the same part of the calendar, or of all parts where it has none."""
    stats = lambda p: [x for c in cols for x in (F.avg(c).alias(f"{p}m_{c}"), F.stddev(c).alias(f"{p}s_{c}"))]
    # a handful of calendar parts
    j = d.join(F.broadcast(train.groupBy(part).agg(*stats(""))), part, "left").crossJoin(F.broadcast(train.agg(*stats("g"))))
    return j.select("event_id", *[((F.col(c) - nz(F.col(f"m_{c}"), F.col(f"gm_{c}"))) / (nz(F.col(f"s_{c}"), F.col(f"gs_{c}")) + 0.001)).alias(f"z_{c}") for c in cols])
