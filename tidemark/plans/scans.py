"""Sources, sinks and cleaning (inventory S and C)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip_hi, clip_lo, nz, r4
from tidemark.registry import query
from tidemark.sources import sinks
from tidemark.sources.views import TX, TXO, table, tx, tx_orders


@query("s01_scan", "S01", "SELECT event_id, user_id, event_type, value FROM events")
def s01(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query("s02_projection", "S02 C22", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def s02(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_type") == "purchase").drop("ts", "user_id", "event_type", "props")


@query("s03_multi_file", "S03 U01", "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY event_type")
def s03(spark, sf):
    both = spark.read.parquet(*[f"{sf}/events.parquet"] * 2)
    return both.groupBy("event_type").agg(F.count("*").alias("n"), r4(F.sum("value")).alias("total"))


@query("s04_glob", "S04 P24", "SELECT count(*)::BIGINT AS n FROM events WHERE value > 20")
def s04(spark, sf):
    return spark.read.parquet(f"{sf}/event*.parquet").filter("value > 20").agg(F.count("*").alias("n"))


@query("s05_unify", "S05 C24", "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation UNION ALL SELECT r_regionkey::BIGINT, r_name, NULL FROM region")
def s05(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return n.unionByName(r, allowMissingColumns=True)


@query("s06_pruned_scan", "S06 C10 J06 U03", TX + " SELECT event_id, customer_id, amt FROM tx WHERE customer_id IN (SELECT customer_id FROM tx WHERE target = 1 AND amt > 120 UNION SELECT customer_id FROM tx WHERE target = 0 AND amt > 140)")
def s06(spark, sf):
    d = tx(spark, sf)
    keys = d.filter("target = 1 and amt > 120").select("customer_id").union(d.filter("target = 0 and amt > 140").select("customer_id")).distinct()
    return d.select("event_id", "customer_id", "amt").join(keys, "customer_id", "left_semi")


@query("s07_cutoff_scan", "S07 J08 C08", TX + """, c AS (SELECT customer_id, min(us) AS cutoff FROM tx WHERE period = 'test' AND customer_id % 3 = 0 GROUP BY ALL)
SELECT event_id, tx.customer_id, us FROM tx LEFT JOIN c ON c.customer_id = tx.customer_id WHERE cutoff IS NULL OR us < cutoff""")
def s07(spark, sf):
    d = tx(spark, sf)
    cut = d.filter("period = 'test' and customer_id % 3 = 0").groupBy("customer_id").agg(F.min("us").alias("cutoff"))
    return d.join(cut, "customer_id", "left").filter("cutoff is null or us < cutoff").select("event_id", "customer_id", "us")


@query("s08_csv_scan", "S08 S10", TX + " SELECT event_id, round(amt / (amt + 50), 6) AS predict FROM tx WHERE period = 'test'")
def s08(spark, sf):
    out = tx(spark, sf).filter("period = 'test'").select("event_id", F.round(F.col("amt") / (F.col("amt") + 50), 6).alias("predict"))
    return sinks.read_csv(spark, sinks.write_csv(out, f"predictions-{uuid.uuid4().hex}"), "event_id long, predict double")


@query("s09_parquet_sink", "S09 S11", TX + " SELECT customer_id, count(*)::BIGINT AS n FROM tx GROUP BY customer_id")
def s09(spark, sf):
    name = f"profiles-{uuid.uuid4().hex}"
    build = lambda: tx(spark, sf).groupBy("customer_id").agg(F.count("*").alias("n"))
    sinks.materialize_once(spark, name, build)
    return sinks.materialize_once(spark, name, build)  # the second time it is there


@query("s12_template_all", "S12 C05", TX + """, p AS (SELECT event_id, amt / (amt + 50) AS predict FROM tx WHERE period = 'test'), m AS (SELECT quantile_cont(predict, 0.5) AS m FROM p)
SELECT tx.event_id, round(coalesce(predict, m), 6) AS predict FROM tx LEFT JOIN p ON p.event_id = tx.event_id, m WHERE period = 'test'""")
def s12_all(spark, sf):
    """Predictions of all rows; missing ones are tested on a small frame."""
    d = tx(spark, sf).filter("period = 'test'")
    pred = d.select("event_id", (F.col("amt") / (F.col("amt") + 50)).alias("predict"))
    return sinks.template_aligned(d.select("event_id"), pred).select("event_id", F.round("predict", 6).alias("predict"))


@query("s13_float_matrix", "S13", "SELECT vec_id, label, round(embedding[1]::FLOAT::DOUBLE, 4) AS f0, round(embedding[64]::FLOAT::DOUBLE, 4) AS f63 FROM embeddings")
def s13(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", "label", r4(e[0].cast("float").cast("double")).alias("f0"), r4(e[63].cast("float").cast("double")).alias("f63"))


@query("s14_artifacts", "S14", TX + " SELECT period, count(*)::BIGINT AS n FROM tx GROUP BY period")
def s14(spark, sf):
    return sinks.json_round_trip(tx(spark, sf).groupBy("period").agg(F.count("*").alias("n")), f"metrics-{uuid.uuid4().hex}")


@query("c01_parse_cast", "C01 C02 F02 F03", """SELECT p_partkey, try_cast(substr(p_brand, 7) AS INT) AS brand_no, try_cast(p_type AS INT) AS type_no,
  p_size AS screen_w, floor(p_retailprice)::INT AS screen_h, (p_size * 2)::DOUBLE AS pct,
  epoch_us(strptime('2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') || ' 10:20:30', '%Y-%m-%d %H:%M:%S')) AS parsed_us FROM part""")
def c01(spark, sf):
    p = table(spark, sf, "part")
    screen = F.split(F.concat_ws("x", "p_size", F.floor("p_retailprice").cast("int")), "x")
    text = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:20:30"))
    pct = F.concat((F.col("p_size") * 2).cast("string"), F.lit("% "))
    return p.select("p_partkey", F.substring("p_brand", 7, 10).try_cast("int").alias("brand_no"), F.col("p_type").try_cast("int").alias("type_no"), screen[0].try_cast("int").alias("screen_w"), F.element_at(screen, -1).try_cast("int").alias("screen_h"), F.trim(F.replace(pct, F.lit("%"), F.lit(""))).try_cast("double").alias("pct"), F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))).alias("parsed_us"))


@query("c03_fills", "C03 C04 C06 C12 C13 C25", TX + """SELECT event_id, coalesce(mcc, -1) AS mcc_filled, coalesce(pos, mcc, 0) AS pos_or_mcc, (mcc IS NULL)::INT AS is_null_mcc, coalesce(mcc = 3, false)::INT AS is_mcc_3,
  coalesce(CASE WHEN mcc - 5 = 0 THEN NULL ELSE r4(amt / (mcc - 5)) END, 0.0) AS safe_ratio FROM tx""")
def c03(spark, sf):
    d = tx(spark, sf)
    ratio = r4(F.try_divide("amt", F.col("mcc") - 5))
    return d.select("event_id", nz(F.col("mcc"), -1).alias("mcc_filled"), F.coalesce("pos", "mcc", F.lit(0)).alias("pos_or_mcc"), F.col("mcc").isNull().cast("int").alias("is_null_mcc"), F.coalesce(F.col("mcc") == 3, F.lit(False)).cast("int").alias("is_mcc_3"), ratio.alias("safe_ratio")).na.fill(0.0, subset=["safe_ratio"])


@query("c07_history_view", "C07 C23", TX + " SELECT customer_id, event_id, us, coalesce(amt, 0.0) AS amt, voip, mcc, session_id, 1 AS one FROM tx WHERE period <> 'test'")
def c07(spark, sf):
    return tx(spark, sf).filter("period <> 'test'").select("customer_id", "event_id", "us", nz(F.col("amt"), 0.0).alias("amt"), "voip", "mcc", "session_id", F.lit(1).alias("one"))


@query("c09_predicates", "C09 C14 C15 C17", TX + """SELECT event_id, (mcc IN (12, 15, 10, 6, 3))::INT AS risky, (hour BETWEEN 0 AND 6)::INT AS night,
  CASE WHEN amt < 10 THEN 'low' WHEN amt < 50 THEN 'mid' ELSE 'high' END AS band, least(mcc, pos, 7) AS low, greatest(mcc, pos) AS top FROM tx WHERE (amt > 5 AND voip = 0) OR NOT (hour < 12)""")
def c09(spark, sf):
    d = tx(spark, sf).filter(((F.col("amt") > 5) & (F.col("voip") == 0)) | ~(F.col("hour") < 12))
    band = F.when(F.col("amt") < 10, "low").when(F.col("amt") < 50, "mid").otherwise("high")
    return d.select("event_id", F.col("mcc").isin(12, 15, 10, 6, 3).cast("int").alias("risky"), F.col("hour").between(0, 6).cast("int").alias("night"), band.alias("band"), F.least("mcc", "pos", F.lit(7)).alias("low"), F.greatest("mcc", "pos").alias("top"))


@query("c11_list_membership", "C11 P14", TX + """, base AS (SELECT DISTINCT customer_id, mcc FROM tx WHERE period = 'pretrain' AND mcc IS NOT NULL)
SELECT event_id, (b.mcc IS NOT NULL)::INT AS known FROM tx LEFT JOIN base b ON b.customer_id = tx.customer_id AND b.mcc = tx.mcc WHERE period = 'train'""")
def c11(spark, sf):
    d = tx(spark, sf)
    sets = d.filter("period = 'pretrain'").groupBy("customer_id").agg(F.sort_array(F.collect_set("mcc")).alias("mccs"))
    return d.filter("period = 'train'").join(sets, "customer_id", "left").select("event_id", F.coalesce(F.array_contains("mccs", F.col("mcc")), F.lit(False)).cast("int").alias("known"))


@query("c16_coalesce_sources", "C16 C21", TX + """, a AS (SELECT customer_id, max(us) AS last FROM tx WHERE period = 'test' AND voip = 1 GROUP BY ALL), b AS (SELECT customer_id, max(us) AS last FROM tx WHERE period = 'pretest' AND voip = 1 GROUP BY ALL), c AS (SELECT customer_id, max(us) AS last FROM tx GROUP BY ALL)
SELECT c.customer_id, coalesce(a.last, b.last, c.last) AS last_us FROM c LEFT JOIN a ON a.customer_id = c.customer_id LEFT JOIN b ON b.customer_id = c.customer_id""")
def c16(spark, sf):
    last = lambda p: F.max(F.when(p, F.col("us")))
    voip = F.col("voip") == 1
    one = tx(spark, sf).groupBy("customer_id").agg(last((F.col("period") == "test") & voip).alias("t_last"), last((F.col("period") == "pretest") & voip).alias("p_last"), F.max("us").alias("a_last"))
    return one.select("customer_id", F.coalesce("t_last", "p_last", "a_last").alias("last_us"))


@query("c18_clip", "C18 X20", TX + "SELECT event_id, CASE WHEN amt < 10 THEN 10.0 ELSE amt END AS lo, CASE WHEN mcc > 50 THEN 50 ELSE mcc END AS hi, CASE WHEN mcc < 5 THEN 5 ELSE mcc END AS mcc_lo FROM tx")
def c18(spark, sf):
    return tx(spark, sf).select("event_id", clip_lo(F.col("amt"), 10.0).alias("lo"), clip_hi(F.col("mcc"), 50).alias("hi"), clip_lo(F.col("mcc"), 5).alias("mcc_lo"))


@query("c19_dedup", "C19", TXO + " SELECT customer_id, event_dttm, event_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, event_dttm ORDER BY event_id) AS k FROM txo) WHERE k = 1")
def c19(spark, sf):
    # keep-first by an aggregate: map-side combined, unlike row_number
    return tx_orders(spark, sf).groupBy("customer_id", "event_dttm").agg(F.min("event_id").alias("event_id"))


@query("c20_distinct_pairs", "C20 U02", TX + " SELECT DISTINCT customer_id, mcc FROM (SELECT customer_id, mcc FROM tx WHERE period = 'train' UNION ALL SELECT customer_id, mcc FROM tx WHERE period = 'test')")
def c20(spark, sf):
    d = tx(spark, sf)
    pair = lambda p: d.filter(F.col("period") == p).select("customer_id", "mcc")
    return pair("train").union(pair("test")).distinct()


@query("f01_time_text", "F01 F05 F06 F07 F08 F13 F17", TX + """SELECT event_id, substr(strftime(event_dttm, '%Y-%m-%d %H:%M:%S'), 12, 2)::INT AS hour_text, substr(strftime(event_dttm, '%Y-%m-%d %H:%M:%S'), 6, 2)::INT AS month_text,
  hour, weekday, month(event_dttm)::INT AS month, day(event_dttm)::INT AS day, date, strftime(event_dttm, '%Y-%m') AS ym, us // 1000000 AS epoch_s, (hour < 6)::INT AS is_night, hour * 7 + weekday AS hour_weekday FROM tx""")
def f01(spark, sf):
    text = F.date_format("event_dttm", "yyyy-MM-dd HH:mm:ss")
    return tx(spark, sf).select("event_id", F.substring(text, 12, 2).cast("int").alias("hour_text"), F.substring(text, 6, 2).cast("int").alias("month_text"), "hour", "weekday", F.month("event_dttm").alias("month"), F.dayofmonth("event_dttm").alias("day"), "date", F.date_format("event_dttm", "yyyy-MM").alias("ym"), F.floor(F.col("us") / 1000000).alias("epoch_s"), (F.col("hour") < 6).cast("int").alias("is_night"), (F.col("hour") * 7 + F.col("weekday")).alias("hour_weekday"))


@query("f04_fingerprint", "F04", "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size::VARCHAR || 'x' || (p_size * 2)::VARCHAR || '_' || coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END, '?') END AS device_fp FROM part")
def f04(spark, sf):
    screen = F.when(F.col("p_size") > 5, F.concat_ws("x", "p_size", F.col("p_size") * 2))
    version = F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.when(screen.isNotNull(), F.concat(screen, F.lit("_"), nz(version, "?"))).alias("device_fp"))


@query("f09_durations", "F09 F10 F11 F12 F14 F15 F16 F18 F20", TX + """, g AS (SELECT *, us - lag(us) OVER (PARTITION BY customer_id ORDER BY us, event_id) AS gap FROM tx)
SELECT event_id, gap // 1000000 AS gap_s, r4(ln(1 + amt)) AS log_amount, r4(log2(amt + 1)) AS l2, r4(sqrt(amt)) AS root, r4(amt * amt) AS sq, abs(hour - 12) AS dist,
  r4(sin(2 * pi() * hour / 24)) AS hour_sin, r4(cos(2 * pi() * hour / 24)) AS hour_cos, r4(amt / (abs(mcc) + 1)) AS ratio, 3 * voip + 2 * (hour < 6)::INT + (mcc = 3)::INT AS risk,
  r4(voip * ln(1 + amt)) AS voip_x_logamt, voip & (hour < 6)::INT AS both, r4(1 / (1 + exp(-amt / 50))) AS sig FROM g""")
def f09(spark, sf):
    gap = F.col("us") - F.lag("us").over(W.partitionBy("customer_id").orderBy("us", "event_id"))
    night = (F.col("hour") < 6).cast("int")
    turn = 2 * F.pi() * F.col("hour") / 24
    return tx(spark, sf).select("event_id", F.floor(gap / 1000000).alias("gap_s"), r4(F.log1p("amt")).alias("log_amount"), r4(F.log2(F.col("amt") + 1)).alias("l2"), r4(F.sqrt("amt")).alias("root"), r4(F.col("amt") * F.col("amt")).alias("sq"), F.abs(F.col("hour") - 12).alias("dist"), r4(F.sin(turn)).alias("hour_sin"), r4(F.cos(turn)).alias("hour_cos"), r4(F.col("amt") / (F.abs("mcc") + 1)).alias("ratio"), (3 * F.col("voip") + 2 * night + (F.col("mcc") == 3).cast("int")).alias("risk"), r4(F.col("voip") * F.log1p("amt")).alias("voip_x_logamt"), F.col("voip").bitwiseAND(night).alias("both"), r4(1 / (1 + F.exp(-F.col("amt") / 50))).alias("sig"))


@query("f19_decay", "F19", TX + """, w AS (SELECT event_id, exp(-greatest(date_diff('day', date, DATE '2024-01-25'), 0) / 90.0) AS w FROM tx WHERE period <> 'test')
SELECT event_id, round(w / (avg(w) OVER ()), 6) AS weight FROM w""")
def f19(spark, sf):
    d = tx(spark, sf).filter("period <> 'test'")
    days = F.datediff(F.lit("2024-01-25").cast("date"), F.col("date"))
    held = d.select("event_id", F.exp(-F.greatest(days, F.lit(0)) / 90.0).alias("w"))
    return held.crossJoin(F.broadcast(held.agg(F.avg("w").alias("m")))).select("event_id", F.round(F.col("w") / F.col("m"), 6).alias("weight"))
