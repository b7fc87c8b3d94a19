"""Score algebra, ranking metrics and comparisons of populations (inventory X)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import r4, r6
from tidemark.operators import scoring as S
from tidemark.registry import query
from tidemark.sources.views import SC, scored, table

_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


def ap_sql(source: str, y: str = "y", s: str = "s3", by: str = "") -> str:
    """CTE bodies g_, c_ that end in a table of ap by group."""
    part, cols = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""(SELECT {cols}sum(tp * ct / cn::DOUBLE) / nullif(sum(tp), 0) AS ap, sum(tp)::BIGINT AS positives, sum(n)::BIGINT AS n FROM (SELECT *, sum(n) OVER ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(tp) OVER ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ct
  FROM (SELECT {cols}{s} AS s, count(*) AS n, sum({y}) AS tp FROM {source} GROUP BY ALL)) {'GROUP BY ' + by if by else ''})"""


@query("x01_blends", "X01 X02 X07", SC + f", k AS (SELECT event_id, s1, s2, s3, {_AVG_RANK.format('s1')} AS k1, {_AVG_RANK.format('s2')} AS k2, count(*) OVER () AS n FROM sc) SELECT event_id, r6((s1 + s2 + s3) / 3) AS seed_mean, r6(0.7::DOUBLE * s1 + 0.3::DOUBLE * s2) AS linear, r6((k1 + k2) / (2 * n)) AS rank_blend, r6(k1 / n * k2 / n) AS rank_product, r6(sqrt(k1 / n * (k2 / n))) AS rank_geo, r6(pow(s1, 1.5)) AS power, r6(ln(1 + k1)) AS log_rank FROM k")
def x01(spark, sf):
    d = scored(spark, sf).select("event_id", "s1", "s2", "s3")
    d = S.global_average_rank(S.global_average_rank(d, "s1", "k1"), "s2", "k2")
    d = d.crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))
    a, b = F.col("k1") / F.col("n"), F.col("k2") / F.col("n")
    return d.select("event_id", r6((F.col("s1") + F.col("s2") + F.col("s3")) / 3).alias("seed_mean"), r6(0.7 * F.col("s1") + 0.3 * F.col("s2")).alias("linear"), r6((F.col("k1") + F.col("k2")) / (2 * F.col("n"))).alias("rank_blend"), r6(a * b).alias("rank_product"), r6(F.sqrt(a * b)).alias("rank_geo"), r6(F.pow("s1", F.lit(1.5))).alias("power"), r6(F.log1p("k1")).alias("log_rank"))


@query("x03_weight_grid", "X03 X08", SC + ", g AS (SELECT i * 0.05::DOUBLE AS w, y, i * 0.05::DOUBLE * s1 + (1 - i * 0.05::DOUBLE) * s2 AS s FROM sc, (SELECT unnest(range(21)) AS i)) SELECT r4(w) AS w, r6(ap) AS ap FROM " + ap_sql("g", s="s", by="w"))
def x03(spark, sf):
    """Every weight of the grid in one plan; the grid has 21 points."""
    d = scored(spark, sf).select("y", "s1", "s2", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    w = F.col("i") * 0.05
    d = d.select(w.alias("w"), "y", (w * F.col("s1") + (1 - w) * F.col("s2")).alias("s"))
    return S.average_precision_by(d, "y", "s", "w").select(r4(F.col("w")).alias("w"), r6(F.col("ap")).alias("ap"))


_BOOST = SC + ", q AS (SELECT quantile_cont(s3, 0.95) AS bar, quantile_cont(s3, 0.8) AS b80 FROM sc), b AS (SELECT sc.*, max(s3) OVER w AS mx, avg(s3) OVER w AS mean, max(s3) OVER w - min(s3) OVER w AS rng, sum((s3 >= bar)::INT) OVER w AS n_high, (row_number() OVER (PARTITION BY customer_id ORDER BY s3 DESC, event_id) - 1)::DOUBLE / greatest(count(*) OVER w - 1, 1) AS pct, b80 FROM sc, q WINDOW w AS (PARTITION BY customer_id))"


@query("x04_entity_boost", "X04 X05", _BOOST + " SELECT event_id, r6(s3 * pow(mx, 3.13)) AS m1, r6(pow(s3, 1.2) * pow(mx, 2)) AS m2, r6(pow(s3, 1.2) * pow(mx, 2) * pow(mean, 0.5)) AS m3, r6(pow(s3, 1.21) * pow(mx, 4.8) * pow(n_high + 1, 0.05) * pow(rng + 0.001, -0.11)) AS m4, r6(pow(s3, 1.2) * pow(mx, 2) * pow(1 - pct, 0.3)) AS m5, r6(CASE WHEN mx > b80 THEN s3 * mx ELSE s3 END) AS conditional FROM b")
def x04(spark, sf):
    d = scored(spark, sf)
    q = S.quantiles(d, "s3", {"p95": 0.95, "p80": 0.8}).select(F.array("p95", "p80").alias("q"))
    w = W.partitionBy("customer_id")
    s, mx, mean = F.col("s3"), F.max("s3").over(w), F.avg("s3").over(w)
    rng, n = mx - F.min("s3").over(w), F.count("*").over(w)
    high = F.sum((s >= F.col("q")[0]).cast("int")).over(w)
    pct = (F.row_number().over(w.orderBy(F.col("s3").desc(), "event_id")) - 1) / F.greatest(n - 1, F.lit(1))
    d = d.crossJoin(F.broadcast(q)).select("event_id", "s3", "q", mx.alias("mx"), mean.alias("mean"), rng.alias("rng"), high.alias("high"), pct.alias("pct"))
    mx, p = F.col("mx"), lambda c, e: F.pow(F.col(c), F.lit(e))
    return d.select("event_id", r6(s * p("mx", 3.13)).alias("m1"), r6(p("s3", 1.2) * p("mx", 2.0)).alias("m2"), r6(p("s3", 1.2) * p("mx", 2.0) * p("mean", 0.5)).alias("m3"), r6(p("s3", 1.21) * p("mx", 4.8) * F.pow(F.col("high") + 1.0, F.lit(0.05)) * F.pow(F.col("rng") + 0.001, F.lit(-0.11))).alias("m4"), r6(p("s3", 1.2) * p("mx", 2.0) * F.pow(1 - F.col("pct"), F.lit(0.3))).alias("m5"), r6(F.when(mx > F.col("q")[1], s * mx).otherwise(s)).alias("conditional"))


@query("x06_day_stack", "X06", SC + " SELECT event_id, r6(s3 * pow(max(s3) OVER w, 1.5)) AS day_max_stack, r6(s3 * avg(s3) OVER w) AS day_mean_stack FROM sc WINDOW w AS (PARTITION BY customer_id, date)")
def x06(spark, sf):
    w = W.partitionBy("customer_id", "date")
    return scored(spark, sf).select("event_id", r6(F.col("s3") * F.pow(F.max("s3").over(w), F.lit(1.5))).alias("day_max_stack"), r6(F.col("s3") * F.avg("s3").over(w)).alias("day_mean_stack"))


@query("x08_average_precision", "X08", SC + " SELECT r6(ap) AS ap, positives, n FROM " + ap_sql("sc"))
def x08(spark, sf):
    return S.average_precision(scored(spark, sf), "y", "s3").select(r6(F.col("ap")).alias("ap"), "positives", "n")


@query("x08_quality_ap", "X08 X09", "WITH d AS (SELECT n_chars, quality FROM documents JOIN labels ON labels.doc_id = documents.doc_id), k AS (SELECT quality, " + _AVG_RANK.format("n_chars") + " AS k FROM d) SELECT r6((SELECT ap FROM " + ap_sql("d", "quality", "n_chars") + ")) AS ap, r6((SELECT (sum(CASE WHEN quality = 1 THEN k END) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * sum(1 - quality)) FROM k)) AS auc")
def x08_quality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id").select("n_chars", "quality")
    return S.average_precision(d, "quality", "n_chars").crossJoin(S.roc_auc(d, "quality", "n_chars")).select(r6(F.col("ap")).alias("ap"), r6(F.col("auc")).alias("auc"))


@query("x09_roc_auc", "X09", SC + f", k AS (SELECT y, {_AVG_RANK.format('s3')} AS k FROM sc) SELECT r6((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))) AS auc FROM k")
def x09(spark, sf):
    return S.roc_auc(scored(spark, sf), "y", "s3").select(r6(F.col("auc")).alias("auc"))


@query("x10_pr_curve", "X10", SC + """, g AS (SELECT s3, count(*) AS n, sum(y) AS tp FROM sc GROUP BY ALL), c AS (SELECT s3, sum(tp) OVER w AS ct, sum(n) OVER w AS cn, sum(tp) OVER () AS p FROM g WINDOW w AS (ORDER BY s3 DESC ROWS UNBOUNDED PRECEDING))
SELECT t.r::DOUBLE AS recall_target, r6(max(s3)) AS threshold, r6(arg_max(ct / cn::DOUBLE, s3)) AS precision FROM c, (VALUES (0.1), (0.25), (0.5), (0.75), (0.9)) t(r) WHERE ct / p::DOUBLE >= t.r GROUP BY t.r""")
def x10(spark, sf):
    d = scored(spark, sf)
    p = S.prefix_counts(d, "s3", {"n": F.count("*"), "tp": F.sum(F.col("y").cast("long"))}).select("s", (F.col("tp_before") + F.col("tp")).alias("ct"), (F.col("n_before") + F.col("n")).alias("cn"))
    p = p.crossJoin(F.broadcast(d.agg(F.sum("y").alias("p"))))
    # five targets: each is one conditional aggregate
    rs = (0.1, 0.25, 0.5, 0.75, 0.9)
    best = lambda r: F.max(F.when(F.col("ct") / F.col("p") >= r, F.struct(F.col("s").alias("t"), (F.col("ct") / F.col("cn")).alias("v"))))
    g = p.agg(*[best(r).alias(f"r{i}") for i, r in enumerate(rs)])
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("recall_target"), F.col(f"r{i}").alias("b")) for i, r in enumerate(rs)]))
    return g.select(rows.alias("x")).select("x.recall_target", r6(F.col("x.b.t")).alias("threshold"), r6(F.col("x.b.v")).alias("precision"))


@query("x11_precision_at_k", "X11", SC + """, k AS (SELECT y, row_number() OVER (ORDER BY s3 DESC, event_id) AS k0, sum(y) OVER () AS p FROM sc), c AS (SELECT customer_id, max(y) AS y, max(s3) AS s FROM sc GROUP BY ALL), ck AS (SELECT y, row_number() OVER (ORDER BY s DESC, customer_id) AS k0, sum(y) OVER () AS p FROM c)
SELECT 'event' AS level, t.k, sum(y)::BIGINT AS tp, r6(sum(y)::DOUBLE / t.k) AS precision, r6(sum(y)::DOUBLE / any_value(p)) AS recall FROM k, (VALUES (50), (100), (430), (1000)) t(k) WHERE k0 <= t.k GROUP BY t.k
UNION ALL SELECT 'customer', t.k, sum(y)::BIGINT, r6(sum(y)::DOUBLE / t.k), r6(sum(y)::DOUBLE / any_value(p)) FROM ck, (VALUES (10), (50)) t(k) WHERE k0 <= t.k GROUP BY t.k""")
def x11(spark, sf):
    d = scored(spark, sf)
    c = d.groupBy("customer_id").agg(F.max("y").alias("y"), F.max("s3").alias("s3"))
    one = S.precision_at(d, "y", "s3", "event_id", (50, 100, 430, 1000)).withColumn("level", F.lit("event"))
    two = S.precision_at(c, "y", "s3", "customer_id", (10, 50)).withColumn("level", F.lit("customer"))
    return one.unionByName(two).select("level", "k", "tp", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


_BAND = "CASE WHEN amt < 10 THEN 'amt<10' WHEN amt < 50 THEN 'amt<50' ELSE 'amt>=50' END"


@query("x12_segments", "X12", SC + f", b AS (SELECT {_BAND} AS band, y, s2 FROM sc UNION ALL SELECT CASE WHEN hour < 6 THEN 'night' ELSE 'day' END, y, s2 FROM sc UNION ALL SELECT CASE WHEN pos = 1 THEN 'pos1' ELSE 'other' END, y, s2 FROM sc) SELECT band, r6(ap) AS ap, positives, n FROM " + ap_sql("b", s="s2", by="band") + " WHERE positives > 0")
def x12(spark, sf):
    amt = F.when(F.col("amt") < 10, "amt<10").when(F.col("amt") < 50, "amt<50").otherwise("amt>=50")
    bands = F.array(amt, F.when(F.col("hour") < 6, "night").otherwise("day"), F.when(F.col("pos") == 1, "pos1").otherwise("other"))
    d = scored(spark, sf).select(F.explode(bands).alias("band"), "y", "s2")
    return S.average_precision_by(d, "y", "s2", "band").filter("positives > 0").select("band", r6(F.col("ap")).alias("ap"), "positives", "n")


@query("x13_score_distribution", "X13 X15", SC + """, c AS (SELECT coalesce(target, 2) AS class, s3 FROM sc), m AS (SELECT median(CASE WHEN class = 0 THEN s3 END) AS mid FROM c)
SELECT class, count(*) AS n, r6(avg(s3)) AS mean, r6(median(s3)) AS median, r6(min(s3)) AS low, r6(max(s3)) AS high, r6(quantile_cont(s3, 0.25)) AS p25, r6(quantile_cont(s3, 0.99)) AS p99, r6(avg((s3 > mid)::INT::DOUBLE)) AS above_confirmed FROM c, m GROUP BY class""")
def x13(spark, sf):
    d = scored(spark, sf).select(F.coalesce("target", F.lit(2)).alias("class"), "s3")
    q = S.quantiles(d, "s3", {"median": 0.5, "p25": 0.25, "p99": 0.99}, by=("class",))
    mid = q.filter("class = 0").agg(F.max("median").alias("mid"))
    g = d.crossJoin(F.broadcast(mid)).groupBy("class").agg(F.count("*").alias("n"), r6(F.avg("s3")).alias("mean"), r6(F.min("s3")).alias("low"), r6(F.max("s3")).alias("high"), r6(F.avg((F.col("s3") > F.col("mid")).cast("double"))).alias("above_confirmed"))
    return g.join(q.select("class", *[r6(F.col(c)).alias(c) for c in ("median", "p25", "p99")]), "class")


_F = ("amt", "hour", "weekday", "mcc")
_UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, period, y FROM sc" for c in _F)


def unpivoted(spark, sf):
    d = scored(spark, sf)
    return d.select("period", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in _F])).alias("x")).select("period", "y", "x.feature", "x.v")


@query("x14_cohorts", "X14", SC + f", u AS ({_UNPIVOT}), g AS (SELECT feature, avg(CASE WHEN y = 1 THEN v END) AS a, avg(CASE WHEN y = 0 THEN v END) AS b FROM u GROUP BY feature) SELECT feature, r4(a) AS mean_a, r4(b) AS mean_b, r4(100 * (a - b) / nullif(b, 0)) AS pct FROM g")
def x14(spark, sf):
    a, b = F.col("a"), F.col("b")
    g = unpivoted(spark, sf).groupBy("feature").agg(F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("a"), F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("b"))
    return g.select("feature", r4(a).alias("mean_a"), r4(b).alias("mean_b"), r4(F.try_divide(100 * (a - b), b)).alias("pct"))


_SHIFT = SC + f", u AS ({_UNPIVOT}), g AS (SELECT feature, avg(CASE WHEN period = 'train' THEN v END) AS a, avg(CASE WHEN period = 'test' THEN v END) AS b, stddev_samp(CASE WHEN period = 'train' THEN v END) AS s, avg(CASE WHEN period = 'train' THEN (v IS NULL)::INT::DOUBLE END) AS na, avg(CASE WHEN period = 'test' THEN (v IS NULL)::INT::DOUBLE END) AS nb, abs(corr(v, y)) AS imp FROM u GROUP BY feature)"


@query("x16_shift", "X16 X17", _SHIFT + " SELECT feature, r4(abs(a - b) / nullif(s, 0)) AS shift, r4(nb - na) AS null_diff, r4(abs(a - b) / nullif(s, 0) * imp) AS danger FROM g")
def x16(spark, sf):
    u = unpivoted(spark, sf)
    of = lambda p, c=F.col("v"): F.when(F.col("period") == p, c)
    null = F.col("v").isNull().cast("double")
    g = u.groupBy("feature").agg(F.avg(of("train")).alias("a"), F.avg(of("test")).alias("b"), F.stddev(of("train")).alias("s"), F.avg(of("train", null)).alias("na"), F.avg(of("test", null)).alias("nb"))
    # corr() of Spark takes pairs with a null as zero: they are left out, as in the twin
    imp = u.filter("v is not null").groupBy("feature").agg(F.abs(F.corr("v", "y")).alias("imp"))
    shift = F.try_divide(F.abs(F.col("a") - F.col("b")), F.col("s"))
    return g.join(imp, "feature").select("feature", r4(shift).alias("shift"), r4(F.col("nb") - F.col("na")).alias("null_diff"), r4(shift * F.col("imp")).alias("danger")).orderBy(F.col("danger").desc()).limit(10)


@query("x18_ipw", "X18", SC + ", p AS (SELECT event_id, least(greatest(s2, 0.01::DOUBLE), 0.99::DOUBLE) AS p FROM sc), w AS (SELECT event_id, least(greatest(p / (1 - p), 0.01::DOUBLE), 20.0::DOUBLE) AS w FROM p) SELECT event_id, r6(w / (SELECT avg(w) FROM w)) AS weight FROM w")
def x18(spark, sf):
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    p = clip(F.col("s2"), 0.01, 0.99)
    w = scored(spark, sf).select("event_id", clip(p / (1 - p), 0.01, 20.0).alias("w"))
    return w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("m")))).select("event_id", r6(F.col("w") / F.col("m")).alias("weight"))


@query("x19_joint_ranks", "X19", SC + f", k AS (SELECT event_id, period, {_AVG_RANK.format('s1')} AS k, count(*) OVER () AS n FROM sc WHERE period IN ('pretest', 'test')) SELECT event_id, r6(k / n) AS joint_rank FROM k WHERE period = 'test'")
def x19(spark, sf):
    d = scored(spark, sf).filter("period in ('pretest', 'test')").select("event_id", "period", "s1")
    d = S.global_average_rank(d, "s1", "k").crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))
    return d.filter("period = 'test'").select("event_id", r6(F.col("k") / F.col("n")).alias("joint_rank"))


@query("x21_class_weights", "X21", SC + ", n AS (SELECT least(sum(1 - y)::DOUBLE / sum(y), 50.0) AS spw FROM sc) SELECT event_id, r4(CASE WHEN y = 1 THEN spw WHEN target IS NULL THEN 1.0 ELSE 5.0 END) AS weight FROM sc, n")
def x21(spark, sf):
    d = scored(spark, sf)
    n = d.agg(F.least(F.sum(1 - F.col("y")) / F.sum("y"), F.lit(50.0)).alias("spw"))
    w = F.when(F.col("y") == 1, F.col("spw")).when(F.col("target").isNull(), 1.0).otherwise(5.0)
    return d.crossJoin(F.broadcast(n)).select("event_id", r4(w).alias("weight"))


@query("x22_monthly_comparison", "X22", SC + ", d AS (SELECT (day(event_dttm) // 10)::BIGINT AS part, y, s1, s2 FROM sc), a AS (SELECT part, ap FROM " + ap_sql("d", s="s1", by="part") + "), b AS (SELECT part, ap FROM " + ap_sql("d", s="s2", by="part") + ") SELECT a.part, r6(a.ap) AS ap_1, r6(b.ap) AS ap_2, r6(a.ap - b.ap) AS diff FROM a JOIN b ON b.part = a.part")
def x22(spark, sf):
    d = scored(spark, sf).withColumn("part", F.floor(F.dayofmonth("event_dttm") / 10))
    a, b = (S.average_precision_by(d, "y", s, "part").select("part", F.col("ap").alias(f"a{s}")) for s in ("s1", "s2"))
    return a.join(b, "part").select("part", r6(F.col("as1")).alias("ap_1"), r6(F.col("as2")).alias("ap_2"), r6(F.col("as1") - F.col("as2")).alias("diff"))


@query("x23_importance", "X23", "WITH i AS (SELECT p_brand AS feature, p_size % 5 AS seed, sum(p_retailprice) AS gain FROM part GROUP BY ALL), g AS (SELECT feature, avg(gain) AS m, stddev_samp(gain) AS s FROM i GROUP BY feature) SELECT feature, r4(m) AS mean_gain, r4(s) AS std_gain, r4(s / m) AS cv, r4(100 * m / sum(m) OVER ()) AS pct, r4(100 * sum(m) OVER (ORDER BY m DESC, feature ROWS UNBOUNDED PRECEDING) / sum(m) OVER ()) AS cum_pct FROM g")
def x23(spark, sf):
    """One row a feature: the running share is over a table of features, not of data rows."""
    i = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature"), (F.col("p_size") % 5).alias("seed")).agg(F.sum("p_retailprice").alias("gain"))
    g = i.groupBy("feature").agg(F.avg("gain").alias("m"), F.stddev("gain").alias("s"))
    every = W.partitionBy()
    run = W.orderBy(F.col("m").desc(), "feature").rowsBetween(W.unboundedPreceding, 0)
    return g.select("feature", r4(F.col("m")).alias("mean_gain"), r4(F.col("s")).alias("std_gain"), r4(F.col("s") / F.col("m")).alias("cv"), r4(100 * F.col("m") / F.sum("m").over(every)).alias("pct"), r4(100 * F.sum("m").over(run) / F.sum("m").over(every)).alias("cum_pct"))


@query("l06_focal_gradient", "L06 F20", SC + ", p AS (SELECT event_id, y, 1 / (1 + exp(-(s3 * 4 - 2))) AS p FROM sc), t AS (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS pt FROM p) SELECT event_id, r6(0.25::DOUBLE * pow(1 - pt, 2) * (p - y)) AS grad, r6(greatest(0.25::DOUBLE * pow(1 - pt, 2) * p * (1 - p), 1e-7::DOUBLE)) AS hess, r6(-0.25::DOUBLE * pow(1 - pt, 2) * ln(pt)) AS loss FROM t")
def l06(spark, sf):
    from tidemark.operators.models import focal

    return focal(scored(spark, sf).select("event_id", "y", (F.col("s3") * 4 - 2).alias("raw")), "y", "raw").select("event_id", *[r6(F.col(c)).alias(c) for c in ("grad", "hess", "loss")])
