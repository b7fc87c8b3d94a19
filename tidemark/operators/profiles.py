"""Entity profiles: moments, quantiles, distinct counts, entropies, modes, gaps, daily patterns, and their blends.

A profile is one ``groupBy`` wherever an aggregate can say it. ``as_of`` keeps only
what lies before a time, so that a profile cannot know the events it is compared with.
Quantiles interpolate linearly over all rows of the entity, whatever files they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from tidemark.functions.exprs import SECOND, clip_lo, entropy_bits, nz

KEY = "customer_id"
LN2_24 = 4.584962500721156  # log2(24)


def distinct_with_null(c: str) -> Column:
    """Distinct values, null counting as one."""
    return (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long")


def share(p: Column) -> Column:
    return F.avg(p.cast("double"))


def basic(df: DataFrame, as_of: Column | None = None, risky: tuple[int, ...] = (12, 15, 10, 6, 3), night: Column | None = None) -> DataFrame:
    """The 16-column profile: a null deviation (one row) becomes 0."""
    d = df if as_of is None else df.filter(F.col("us") < as_of)
    night = F.col("hour") < 6 if night is None else night
    n, span = F.count("*"), (F.max("us") - F.min("us")) / SECOND
    return d.groupBy(KEY).agg(
        F.avg("amt").alias("cust_avg_amt"), nz(F.stddev("amt"), 0.0).alias("cust_std_amt"), F.percentile("amt", F.array(F.lit(0.5), F.lit(0.95))).alias("q"), F.max("amt").alias("cust_max_amt"),
        n.alias("cust_n_tx"), distinct_with_null("mcc").alias("cust_n_unique_mcc"), F.countDistinct("event_type").alias("cust_n_unique_channel"), F.avg("hour").alias("cust_avg_hour"), nz(F.stddev("hour"), 0.0).alias("cust_hour_std"),
        share(night).alias("cust_pct_night"), nz(share(F.col("mcc").isin(*risky)), 0.0).alias("cust_pct_high_risk"), (span / 86400).alias("cust_tenure_days"), (span / clip_lo(n - 1, 1)).alias("cust_avg_gap_sec"), (F.max("us") / SECOND).alias("cust_last_epoch"),
    ).select("*", F.col("q")[0].alias("cust_med_amt"), F.col("q")[1].alias("cust_p95_amt")).drop("q")


def value_counts(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """(entity, part, value, n): how often the entity has each value of each column, null too, from one pass."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _number(F.col(c), df.schema[c].dataType).alias("value")) for i, c in enumerate(cols)]))
    return df.select(KEY, parts.alias("x")).groupBy(KEY, "x.part", "x.value").agg(F.count("*").alias("n"))


def _number(c: Column, kind) -> Column:
    return F.unix_date(c).cast("long") if isinstance(kind, DateType) else c.cast("long")


def moments(df: DataFrame, *more: Column) -> DataFrame:
    """The part of the deep profile that needs no distinct count."""
    q = F.percentile("amt", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]))
    g = df.groupBy(KEY).agg(
        F.avg("amt").alias("prof_amt_mean"), F.stddev("amt").alias("prof_amt_std"), F.min("amt").alias("prof_amt_min"), F.max("amt").alias("prof_amt_max"), q.alias("q"),
        F.avg("hour").alias("prof_hour_mean"), F.stddev("hour").alias("prof_hour_std"), share((F.col("hour") >= 22) | (F.col("hour") < 6)).alias("prof_pct_night"), share(F.col("weekday") >= 6).alias("prof_pct_weekend"),
        F.count("*").alias("prof_n_tx"), F.sum("voip").alias("prof_voip"), *more,
    )
    names = ("p10", "p25", "median", "p75", "p90", "p95", "p99")
    return g.select("*", *[F.col("q")[i].alias(f"prof_amt_{k}") for i, k in enumerate(names)]).drop("q")


def rates(profile: DataFrame) -> DataFrame:
    return profile.withColumns({
        "prof_amt_iqr": F.col("prof_amt_p75") - F.col("prof_amt_p25"),
        "prof_tx_per_day": F.col("prof_n_tx") / clip_lo(F.col("prof_active_days"), 1),
        "prof_amt_cv": F.col("prof_amt_std") / clip_lo(F.col("prof_amt_mean"), 0.01),
        "prof_voip_rate": F.col("prof_voip") / F.col("prof_n_tx"),
    })


def distinct_counts(i: dict[str, int]) -> list[Column]:
    """Aggregates over ``value_counts``: null counts as a value, but not as a day."""
    return [F.count_if(F.col("part") == i["mcc"]).alias("prof_n_mcc"), F.count_if(F.col("part") == i["session_id"]).alias("prof_n_sessions"), F.count_if((F.col("part") == i["date"]) & F.col("value").isNotNull()).alias("prof_active_days")]


def deep_main(df: DataFrame) -> DataFrame:
    """Moments, quantiles, shares and counts of the deep profile, with the rates derived from them."""
    cols = ("mcc", "session_id", "date")
    counts = value_counts(df, cols).groupBy(KEY).agg(*distinct_counts({c: i for i, c in enumerate(cols)}))
    return rates(moments(df).join(counts, KEY))


def entropy(df: DataFrame, c: str) -> DataFrame:
    """Bits of the entity's distribution of a value: two aggregations, no list is gathered."""
    counts = df.groupBy(KEY, c).agg(F.count("*").alias("n"))
    return counts.groupBy(KEY).agg(entropy_bits(F.col("n"), F.sum("n")).alias(f"prof_{c}_entropy"))


def mode(df: DataFrame, c: str) -> DataFrame:
    """The most frequent value and its count; among equals the smallest."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(KEY, c).agg(F.count("*").alias("n"))
    top = F.max(F.struct(F.col("n"), (-F.col(c)).alias("low")))
    return counts.groupBy(KEY).agg(top.alias("t")).select(KEY, (-F.col("t.low")).alias(f"prof_top_{c}"), F.col("t.n").alias(f"prof_top_{c}_n"))


def gaps(df: DataFrame) -> DataFrame:
    """Whole seconds between successive events."""
    gap = F.floor((F.col("us") - F.lag("us").over(W.partitionBy(KEY).orderBy("us", "event_id"))) / SECOND)
    return df.select(KEY, gap.alias("gap")).groupBy(KEY).agg(F.median("gap").alias("prof_gap_median"), F.avg("gap").alias("prof_gap_mean"), F.stddev("gap").alias("prof_gap_std"), F.percentile("gap", F.lit(0.95)).alias("prof_gap_p95"))


def daily(df: DataFrame) -> DataFrame:
    days = df.groupBy(KEY, "date").agg(F.count("*").alias("n"))
    return days.groupBy(KEY).agg(F.avg("n").alias("daily_mean"), F.stddev("n").alias("daily_std"), F.median("n").alias("daily_median"), F.max("n").alias("daily_max"), F.percentile("n", F.lit(0.95)).alias("daily_p95"), F.count("*").alias("n_active_days"))


def deep(df: DataFrame) -> DataFrame:
    """The whole deep profile from two passes: one over the events in order (moments and gaps), one over counts of values.

    Both are keyed by the entity, and are joined one to one.
    """
    gap = F.floor((F.col("us") - F.lag("us").over(W.partitionBy(KEY).orderBy("us", "event_id"))) / SECOND)
    q = F.percentile("gap", F.array(F.lit(0.5), F.lit(0.95))).alias("g")
    first = moments(df.withColumn("gap", gap), F.avg("gap").alias("prof_gap_mean"), F.stddev("gap").alias("prof_gap_std"), q)
    first = first.select("*", F.col("g")[0].alias("prof_gap_median"), F.col("g")[1].alias("prof_gap_p95")).drop("g")
    cols = ("mcc", "session_id", "date", "hour")
    i = {c: k for k, c in enumerate(cols)}
    of = lambda c, x: F.when(F.col("part") == i[c], x)
    n = F.col("n")
    bits = lambda c: entropy_bits(of(c, n), F.sum(of(c, n))).alias(f"prof_{c}_entropy")
    top = F.max(F.when((F.col("part") == i["mcc"]) & F.col("value").isNotNull(), F.struct(n.alias("n"), (-F.col("value")).alias("low")))).alias("t")
    days = F.percentile(of("date", n), F.array(F.lit(0.5), F.lit(0.95))).alias("d")
    counts = value_counts(df, cols).groupBy(KEY).agg(*distinct_counts(i), bits("hour"), bits("mcc"), top, days, F.avg(of("date", n)).alias("daily_mean"), F.stddev(of("date", n)).alias("daily_std"), F.max(of("date", n)).alias("daily_max"), F.count_if(F.col("part") == i["date"]).alias("n_active_days"))
    mcc = df.schema["mcc"].dataType
    counts = counts.select("*", (-F.col("t.low")).cast(mcc).alias("prof_top_mcc"), F.col("t.n").alias("prof_top_mcc_n"), F.col("d")[0].alias("daily_median"), F.col("d")[1].alias("daily_p95")).drop("t", "d")
    return rates(first.join(counts, KEY))


def by_mcc(df: DataFrame) -> DataFrame:
    return df.filter(F.col("mcc").isNotNull()).groupBy(KEY, "mcc").agg(F.avg("amt").alias("mcc_amt_mean"), F.count("*").alias("mcc_n"))


def day_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(KEY, "date").agg(F.count("*").alias("day_n_ops"), F.sum("amt").alias("day_total_amt"), F.max("amt").alias("day_max_amt"), F.avg("amt").alias("day_mean_amt"), distinct_with_null("mcc").alias("day_n_mcc"), distinct_with_null("session_id").alias("day_n_sessions"), ((F.max("us") - F.min("us")) / SECOND).alias("day_span_sec"))


def from_moments(n: Column, total: Column, squares: Column) -> dict[str, Column]:
    """Mean, population deviation and Gaussian quantiles from additive moments."""
    mean = total / clip_lo(n, 1)
    std = F.sqrt(F.greatest(squares / clip_lo(n, 1) - mean * mean, F.lit(0.0)))
    return {"mean": mean, "std": std, "p95": mean + 1.645 * std, "p99": mean + 2.326 * std, "iqr": 1.35 * std, "median": mean}


def blended(old: DataFrame, new: DataFrame, cols: tuple[str, ...], n: str = "prof_n_tx", full: float = 200.0, most: float = 0.6) -> DataFrame:
    """a of the new profile and 1 - a of the old, a = min(n_new / full, most); where the new is null, the old."""
    b = new.select(KEY, F.col(n).alias("__n"), *[F.col(c).alias(f"__{c}") for c in cols])
    a = F.when(F.col("__n") / full > most, F.lit(most)).otherwise(F.col("__n") / full)
    return old.join(b, KEY, "left").select(KEY, *[F.when(F.col(f"__{c}").isNull() | F.col("__n").isNull(), F.col(c)).otherwise(a * F.col(f"__{c}") + (1 - a) * F.col(c)).alias(c) for c in cols])


def hybrid(old: DataFrame, new: DataFrame, least: int = 10, n: str = "prof_n_tx") -> DataFrame:
    """The new profile of entities with at least so many rows in it, the old one of the others."""
    good = new.filter(F.col(n) >= least)
    return good.unionByName(old.join(good.select(KEY), KEY, "left_anti"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select(KEY, F.col("prof_amt_mean").alias("om"), F.col("prof_tx_per_day").alias("ot"), F.col("prof_hour_mean").alias("oh"))
    away = F.abs(F.col("prof_hour_mean") - F.col("oh"))
    return new.join(o, KEY).select(KEY, (F.col("prof_amt_mean") / clip_lo(F.col("om"), 1.0)).alias("drift_amt"), (F.col("prof_tx_per_day") / clip_lo(F.col("ot"), 0.1)).alias("drift_freq"), F.when(away > 12, 12.0).otherwise(away).alias("drift_hour"))


def reputation(df: DataFrame, c: str, weight: float = 10.0) -> DataFrame:
    """Label rate of a value, its lift over the whole, and its smoothed rate."""
    total = df.agg(F.avg("y").alias("mu"))
    g = df.groupBy(c).agg(F.count("*").alias("n"), F.sum("y").alias("n_fraud"), F.avg("y").alias("rate"))
    return g.crossJoin(F.broadcast(total)).select(c, "n", "n_fraud", "rate", (F.col("rate") / (F.col("mu") + 1e-6)).alias("lift"), ((F.col("n_fraud") + weight * F.col("mu")) / (F.col("n") + weight)).alias("smooth"))
