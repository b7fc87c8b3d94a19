"""Joins, ordering, set operations, samples and encodings (inventory J, O, U, M, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND, arith_hash, r6
from tidemark.operators import encode, sampling
from tidemark.operators.scoring import ordinal, quantiles
from tidemark.registry import query
from tidemark.sources.views import SC, TX, scored, tx


def H(key: str, seed: int = 42) -> str:
    """The twin of ``arith_hash``, in 128 bits."""
    return f"(((({key}) * 2654435761::HUGEINT + {seed * 40503}) % 4294967296 + 4294967296) % 4294967296)::BIGINT"


@query("j05_day_semi_join", "J05 J06", TX + ", k AS (SELECT DISTINCT customer_id, date FROM tx WHERE target = 1) SELECT event_id, customer_id, date FROM tx WHERE EXISTS (SELECT 1 FROM k WHERE k.customer_id = tx.customer_id AND k.date = tx.date)")
def j05(spark, sf):
    d = tx(spark, sf)
    keys = d.filter("target = 1").select("customer_id", "date").distinct()
    return d.join(keys, ["customer_id", "date"], "left_semi").select("event_id", "customer_id", "date")


@query("j07_anti_join", "J07 C10", TX + " SELECT event_id FROM tx WHERE period = 'train' AND customer_id NOT IN (SELECT customer_id FROM tx WHERE target = 1 AND amt > 120)")
def j07(spark, sf):
    d = tx(spark, sf)
    ids = d.filter("target = 1 and amt > 120").select("customer_id").distinct()
    return d.filter("period = 'train'").join(ids, "customer_id", "left_anti").select("event_id")


@query("j09_as_of_lookup", "J09 J08", TX + """, t AS (SELECT customer_id, min(us) AS cut FROM tx WHERE period = 'test' GROUP BY ALL),
l AS (SELECT t.customer_id, cut, max(CASE WHEN period = 'test' AND us < cut THEN us END) AS a, max(CASE WHEN period = 'pretest' AND us < cut AND voip = 1 THEN us END) AS b, max(CASE WHEN us < cut THEN us END) AS c FROM t LEFT JOIN tx ON tx.customer_id = t.customer_id GROUP BY ALL)
SELECT customer_id, cut, coalesce(a, b, c) AS last_us, r6((cut - coalesce(a, b, c)) / 86400000000.0::DOUBLE) AS dormancy_days FROM l""")
def j09(spark, sf):
    """Latest event strictly before a cutoff, from three sources by priority: one join and one aggregate."""
    d = tx(spark, sf)
    cut = d.filter("period = 'test'").groupBy("customer_id").agg(F.min("us").alias("cut"))
    last = lambda p: F.max(F.when(p & (F.col("us") < F.col("cut")), F.col("us")))
    g = cut.join(d.select("customer_id", "us", "period", "voip"), "customer_id", "left").groupBy("customer_id", "cut").agg(last(F.col("period") == "test").alias("a"), last((F.col("period") == "pretest") & (F.col("voip") == 1)).alias("b"), last(F.lit(True)).alias("c"))
    found = F.coalesce("a", "b", "c")
    return g.select("customer_id", "cut", found.alias("last_us"), r6((F.col("cut") - found) / (86400 * SECOND)).alias("dormancy_days"))


@query("o01_sort_limit", "O01 O02", TX + " SELECT customer_id, event_id, amt FROM tx ORDER BY customer_id, amt DESC, event_id LIMIT 500")
def o01(spark, sf):
    return tx(spark, sf).select("customer_id", "event_id", "amt").orderBy("customer_id", F.col("amt").desc(), "event_id").limit(500)


@query("o03_top_k", "O03", SC + " SELECT event_id, r6(s3) AS s3, y FROM sc ORDER BY s3 DESC, event_id LIMIT 430")
def o03(spark, sf):
    return scored(spark, sf).select("event_id", "s3", "y").orderBy(F.col("s3").desc(), "event_id").limit(430).withColumn("s3", r6(F.col("s3")))


@query("o04_top_entities", "O04", SC + ", e AS (SELECT customer_id FROM sc GROUP BY customer_id ORDER BY max(s3) DESC, customer_id LIMIT 20) SELECT event_id, CASE WHEN e.customer_id IS NULL THEN 0.0 ELSE r6(s3) END AS kept_score FROM sc LEFT JOIN e ON e.customer_id = sc.customer_id")
def o04(spark, sf):
    d = scored(spark, sf)
    top = d.groupBy("customer_id").agg(F.max("s3").alias("m")).orderBy(F.col("m").desc(), "customer_id").limit(20).select("customer_id", F.lit(1).alias("k"))
    return d.join(F.broadcast(top), "customer_id", "left").select("event_id", F.when(F.col("k").isNull(), 0.0).otherwise(r6(F.col("s3"))).alias("kept_score"))


@query("o05_percentile_mask", "O05", SC + " SELECT event_id FROM sc WHERE s3 >= (SELECT quantile_cont(s3, 0.9) FROM sc)")
def o05(spark, sf):
    d = scored(spark, sf)
    return d.crossJoin(F.broadcast(quantiles(d, "s3", {"bar": 0.9}))).filter("s3 >= bar").select("event_id")


@query("o06_halves", "O06", SC + ", p AS (SELECT event_id, row_number() OVER (ORDER BY s3, event_id) AS k, count(*) OVER () AS n FROM sc WHERE target = 1) SELECT event_id, CASE WHEN k <= n // 2 THEN 'missed' ELSE 'caught' END AS half FROM p")
def o06(spark, sf):
    """Lower and upper half of the positives by score; ties by id."""
    p = ordinal(scored(spark, sf).filter("target = 1").select("event_id", "s3"), "s3", "event_id", "k")
    return p.crossJoin(F.broadcast(p.agg(F.count("*").alias("n")))).select("event_id", F.when(F.col("k") <= F.floor(F.col("n") / 2), "missed").otherwise("caught").alias("half"))


@query("o07_group_sizes", "O07", TX + " SELECT customer_id, count(*) AS size FROM tx WHERE period = 'train' GROUP BY customer_id")
def o07(spark, sf):
    return tx(spark, sf).filter("period = 'train'").groupBy("customer_id").agg(F.count("*").alias("size"))


@query("u04_overlap", "U03 U04", TX + """, a AS (SELECT DISTINCT customer_id, mcc FROM tx WHERE period = 'train'), b AS (SELECT DISTINCT customer_id, mcc FROM tx WHERE period = 'test')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either""")
def u04(spark, sf):
    """Intersection, differences and union in one shuffle: each pair with the sides that have it."""
    d = tx(spark, sf).filter("period in ('train', 'test')")
    g = d.groupBy("customer_id", "mcc").agg(F.max(F.col("period") == "train").alias("a"), F.max(F.col("period") == "test").alias("b"))
    return g.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("b")).alias("only_a"), F.count_if(~F.col("a")).alias("only_b"), F.count("*").alias("either"))


@query("u04_set_operators", "U04", TX + ", a AS (SELECT customer_id FROM tx WHERE target = 1 AND amt > 120), b AS (SELECT customer_id FROM tx WHERE target = 0 AND amt > 120) SELECT 'both' AS part, customer_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', customer_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def u04_sets(spark, sf):
    d = tx(spark, sf)
    a, b = (d.filter(f"target = {v} and amt > 120").select("customer_id") for v in (1, 0))
    return a.intersect(b).select(F.lit("both").alias("part"), "customer_id").union(a.subtract(b).select(F.lit("only_a"), "customer_id"))


@query("m01_ratio_sample", "M01 M02", TX + f", n AS (SELECT 5.0::DOUBLE * count_if(target = 1) / count_if(target IS NULL) AS f FROM tx) SELECT event_id, target FROM tx, n WHERE target IS NOT NULL OR {H('event_id')} < f * 4294967296.0::DOUBLE")
def m01(spark, sf):
    return sampling.ratio_sample(tx(spark, sf), "target", 5.0).select("event_id", "target")


@query("m03_one_day_each", "M03", TX + f", d AS (SELECT DISTINCT customer_id, date FROM tx), p AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {H('customer_id::HUGEINT * 1000 + dayofyear(date)')}, date) AS k FROM d) SELECT event_id FROM tx JOIN p ON p.customer_id = tx.customer_id AND p.date = tx.date AND k = 1")
def m03(spark, sf):
    return sampling.one_day_each(tx(spark, sf)).select("event_id")


@query("m04_full_days", "M04", TX + f", d AS (SELECT customer_id, date, bool_or(target IS NOT NULL) AS marked FROM tx GROUP BY ALL), n AS (SELECT 0.5::DOUBLE * count_if(marked) / count_if(NOT marked) AS f FROM d), p AS (SELECT customer_id, date FROM d, n WHERE marked OR {H('customer_id::HUGEINT * 1000 + dayofyear(date)')} < f * 4294967296.0::DOUBLE) SELECT event_id FROM tx JOIN p ON p.customer_id = tx.customer_id AND p.date = tx.date")
def m04(spark, sf):
    return sampling.full_days(tx(spark, sf), "target", 0.5).select("event_id")


@query("m05_hard_negatives", "M05", SC + f" SELECT event_id, y FROM sc WHERE y = 1 OR s3 >= (SELECT quantile_cont(s3, 0.9) FROM sc WHERE y = 0) OR {H('event_id')} < 0.1::DOUBLE * 4294967296.0::DOUBLE")
def m05(spark, sf):
    return sampling.hard_negatives(scored(spark, sf), "y", "s3", 0.1, 0.1).select("event_id", "y")


@query("m06_time_split", "M06", TX + " SELECT event_id, CASE WHEN event_dttm < TIMESTAMP '2024-01-21 00:00:00' THEN 'train' ELSE 'val' END AS split FROM tx")
def m06(spark, sf):
    early = F.col("event_dttm") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")
    return tx(spark, sf).select("event_id", F.when(early, "train").otherwise("val").alias("split"))


@query("m07_fixed_sample", "M07 M10", TX + f" SELECT event_id FROM tx ORDER BY {H('event_id')}, event_id LIMIT 777")
def m07(spark, sf):
    return sampling.fixed_size(tx(spark, sf).select("event_id"), 777)


@query("m10_shuffle", "M10", TX + f", h AS (SELECT event_id, {H('event_id')} AS h FROM tx) SELECT event_id, row_number() OVER (ORDER BY h, event_id) AS place FROM h")
def m10(spark, sf):
    """The whole table shuffled; places are numbered by ranges of the hash."""
    d = tx(spark, sf).select("event_id").withColumn("h", arith_hash(F.col("event_id")))
    return sampling.shuffled(ordinal(d, "h", "event_id", "place").select("event_id", "place"))


@query("m08_folds", "M08", SC + f" SELECT event_id, y, ((row_number() OVER (PARTITION BY y ORDER BY {H('event_id')}, event_id) - 1) % 5)::INT AS fold FROM sc")
def m08(spark, sf):
    return sampling.folds(scored(spark, sf).select("event_id", "y"), "y", 5)


@query("m09_partitions", "M09", TX + f" SELECT ({H('customer_id')} % 32)::INT AS chunk, count(*) AS n, count(DISTINCT customer_id) AS customers FROM tx GROUP BY ALL")
def m09(spark, sf):
    d = tx(spark, sf).withColumn("chunk", (arith_hash(F.col("customer_id")) % 32).cast("int"))
    return d.groupBy("chunk", "customer_id").agg(F.count("*").alias("n")).groupBy("chunk").agg(F.sum("n").alias("n"), F.count("*").alias("customers"))


_TRAIN = SC + ", t AS (SELECT * FROM sc WHERE period IN ('pretrain', 'train')), m AS (SELECT avg(y) AS mu FROM t)"


@query("n01_target_encoding", "N01", _TRAIN + ", g AS (SELECT mcc, (sum(y) + any_value(mu) * 20) / (count(*) + 20) AS te FROM t, m GROUP BY mcc) SELECT event_id, r6(coalesce(te, mu)) AS te FROM sc LEFT JOIN g ON g.mcc = sc.mcc, m WHERE period = 'test'")
def n01(spark, sf):
    d = scored(spark, sf)
    return encode.apply_target(d.filter("period = 'test'"), d.filter("period in ('pretrain', 'train')"), "mcc").select("event_id", r6(F.col("te")).alias("te"))


@query("n02_leave_one_out", "N02", _TRAIN + " SELECT event_id, r6(CASE WHEN count(*) OVER w = 1 THEN mu ELSE (sum(y) OVER w - y) / (count(*) OVER w - 1 + 20.0::DOUBLE) + mu * 20 / (count(*) OVER w - 1 + 20.0::DOUBLE) END) AS te_loo FROM t, m WINDOW w AS (PARTITION BY mcc)")
def n02(spark, sf):
    d = scored(spark, sf).filter("period in ('pretrain', 'train')")
    return encode.leave_one_out(d, "mcc").select("event_id", r6(F.col("te_loo")).alias("te_loo"))


@query("n03_frequency", "N03", _TRAIN + ", g AS (SELECT mcc, count(*) AS n FROM t GROUP BY mcc) SELECT event_id, r6(coalesce(n::DOUBLE / (SELECT count(*) FROM t), 0.0)) AS freq FROM sc LEFT JOIN g ON g.mcc IS NOT DISTINCT FROM sc.mcc WHERE period = 'test'")
def n03(spark, sf):
    d = scored(spark, sf)
    return encode.frequency(d.filter("period = 'test'"), d.filter("period in ('pretrain', 'train')"), "mcc").select("event_id", r6(F.col("freq")).alias("freq"))
