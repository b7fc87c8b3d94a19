"""Trained models (inventory L): their scores hang on the trainer, so only their shape is checked in SQL."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import r4
from tidemark.operators import isolation as I
from tidemark.operators import linear as L
from tidemark.operators import models as M
from tidemark.operators import scoring as S
from tidemark.operators import search
from tidemark.operators import windows as O
from tidemark.registry import query
from tidemark.sources.views import scored, tx

FEATURES = ("amt", "hour", "weekday", "cnt_24h", "amt_sum_24h", "secs_since_last", "session_ops_before", "is_new_mcc")


def frame(spark, sf, features=FEATURES):
    h = O.history(tx(spark, sf)).withColumn("y", (F.col("amt") * F.col("hour") > 600).cast("int"))
    return M.assembled(h.select("event_id", "customer_id", "period", "y", "target", *features), features, "y")


#: Features of the linear scorers and of the isolation forest.
LINEAR = ("amt", "hour", "weekday", "voip")


def linear_frame(spark, sf):
    return tx(spark, sf).select("event_id", "customer_id", "period", *LINEAR, (F.col("amt") * F.col("hour") > 600).cast("int").alias("y"))


def halves(d):
    return d.filter("period in ('pretrain', 'train')"), d.filter("period = 'test'")


@query("l01_gbt_ensemble", "L01 X01")
def l01(spark, sf):
    train, test = halves(frame(spark, sf))
    train = train.withColumn("val", F.col("event_id") % 5 == 0).withColumn("w", F.when(F.col("y") == 1, 3.0).otherwise(1.0))
    train = M.stored(train)
    return M.ensemble(train, test, "y", weight="w", validation="val").select("event_id", "y", "score")


@query("l02_second_learner", "L02")
def l02(spark, sf):
    train, test = halves(frame(spark, sf))
    return M.ensemble(M.stored(train), test, "y", kind="forest", seeds=(7,)).select("event_id", "y", "score")


@query("l03_two_stage", "L03")
def l03(spark, sf):
    """Whether a row is labelled, then what its label is, then both scores times each other."""
    train, test = halves(frame(spark, sf).withColumn("sus", F.col("target").isNotNull().cast("double")))
    train = M.stored(train)
    one = M.learner("gbt", "sus", 1, trees=5).fit(train)
    labelled = train.filter("target is not null").withColumn("fraud", F.col("target").cast("double"))
    two = M.learner("gbt", "fraud", 2, trees=5).fit(labelled)
    out = M.predict(two, M.predict(one, test, "p_suspicious"), "p_fraud")
    return out.select("event_id", "p_suspicious", "p_fraud", (F.col("p_suspicious") * F.col("p_fraud")).alias("score"))


@query("l04_out_of_fold", "L04 M08")
def l04(spark, sf):
    train, _ = halves(frame(spark, sf))
    return M.out_of_fold(train.filter("target is not null").withColumn("y", F.col("target").cast("double")), "y").select("event_id", "fold", "oof")


@query("l05_adversarial", "L05 X09")
def l05(spark, sf):
    """How well test rows can be told from training rows: 0.5 means not at all."""
    features = ("amt", "hour", "weekday", "is_new_mcc")
    train, test = halves(frame(spark, sf, features))
    both = train.withColumn("is_test", F.lit(0.0)).unionByName(test.withColumn("is_test", F.lit(1.0)))
    oof = M.out_of_fold(both, "is_test", k=2)
    return S.roc_auc(oof.withColumn("is_test", F.col("is_test").cast("int")), "is_test", "oof").select(r4(F.col("auc")).alias("auc"))


@query("l09_ablation", "L09")
def l09(spark, sf):
    """Average precision of named feature sets; the loop is over a fixed handful of experiments."""
    sets = {"all": FEATURES, "no_velocity": ("amt", "hour", "weekday", "is_new_mcc"), "velocity_only": ("cnt_24h", "amt_sum_24h", "secs_since_last")}
    rows = None
    for name, features in sets.items():
        train, test = halves(frame(spark, sf, features))
        scores = M.ensemble(train, test, "y", seeds=(1,), trees=5)
        one = S.average_precision(scores, "y", "score").select(F.lit(name).alias("experiment"), F.lit(len(features)).alias("n_features"), "ap")
        rows = one if rows is None else rows.unionByName(one)
    return rows.orderBy(F.col("ap").desc())


@query("x03_nelder_mead", "X03")
def x03_search(spark, sf):
    """Weights of three scores by a simplex search from four starts, 12 rounds; the rows are written once, each evaluation reads them twice."""
    d = scored(spark, sf)
    d = M.stored(d.select("y", "s1", "s2", (F.col("hour") / 24).alias("s4")))
    w, ap = search.nelder_mead(d, "y", ("s1", "s2", "s4"))
    return spark.createDataFrame([(*map(float, w), float(ap))], "w1 double, w2 double, w3 double, ap double")


@query("l06_focal_training", "L06")
def l06_training(spark, sf):
    """A linear scorer trained with the focal loss."""
    train, test = halves(linear_frame(spark, sf))
    like = M.stored(train)
    w = L.descend(M.stored(L.standardized(like, LINEAR)), L.focal_pull("y"), len(LINEAR) + 1, 20, 4.0)
    return L.standardized(test, LINEAR, like).select("event_id", "y", (1 / (1 + F.exp(-L.linear(w)))).alias("score"))


@query("l07_group_ranker", "L07 O07")
def l07(spark, sf):
    """A linear scorer that ranks the events of a customer, trained with the softmax cross entropy of each customer's list."""
    train, test = halves(linear_frame(spark, sf))
    like = M.stored(train)
    w = L.descend(M.stored(L.standardized(like, LINEAR)), L.list_pull("y", "customer_id"), len(LINEAR) + 1, 20, 20.0)
    return L.standardized(test, LINEAR, like).select("event_id", "customer_id", "y", L.linear(w).alias("score"))


@query("l08_isolation_forest", "L08")
def l08(spark, sf):
    d = tx(spark, sf).select("event_id", *LINEAR)
    return I.anomaly(d, I.forest(d, LINEAR), LINEAR).select("event_id", F.round("anomaly", 6).alias("anomaly"))


@query("s14_model_files", "S14")
def s14_model(spark, sf):
    """Test scores of a model that was saved and loaded."""
    train, test = halves(frame(spark, sf, ("amt", "hour", "weekday", "is_new_mcc")))
    path = M.saved(M.learner("gbt", "y", 1, trees=3).fit(train), spark, f"gbt-{uuid.uuid4().hex}")
    return M.predict(GBTClassificationModel.load(path), test, "score").select("event_id", "score")


CATEGORY = {"amt": "amount", "hour": "time", "weekday": "time", "cnt_24h": "velocity", "amt_sum_24h": "velocity", "secs_since_last": "velocity", "session_ops_before": "session", "is_new_mcc": "merchant"}


def trained_importances(spark, sf):
    train, test = halves(frame(spark, sf))
    train = M.stored(train)
    return train, test, M.importances([M.learner("gbt", "y", k, trees=3).fit(train) for k in (1, 2, 3)], FEATURES, spark)


@query("x23_model_importance", "X23")
def x23_model(spark, sf):
    """Importances of three trained models by feature and category. The tables have one row a feature."""
    _, _, i = trained_importances(spark, sf)
    g = i.groupBy("feature").agg(F.avg("gain").alias("m"), F.stddev("gain").alias("s"))
    category = F.create_map(*[F.lit(v) for kv in CATEGORY.items() for v in kv])[F.col("feature")]
    run = W.orderBy(F.col("m").desc(), "feature").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("m").over(W.partitionBy())
    of = F.sum("m").over(W.partitionBy("category"))
    return g.withColumn("category", category).select("feature", "category", r4(F.col("m")).alias("mean_gain"), r4(F.col("s")).alias("std_gain"), r4(F.try_divide(F.col("s"), F.col("m"))).alias("cv"), r4(100 * F.col("m") / total).alias("pct"), r4(100 * F.sum("m").over(run) / total).alias("cum_pct"), r4(100 * of / total).alias("category_pct"))


@query("x17_danger", "X17")
def x17(spark, sf):
    """Shift of each feature from training to test rows times its importance in trained models; the ten highest."""
    train, test, i = trained_importances(spark, sf)
    stats = train.agg(*[f(c).alias(f"{c}_{k}") for c in FEATURES for k, f in (("m", F.avg), ("s", F.stddev))]).crossJoin(test.agg(*[F.avg(c).alias(f"{c}_t") for c in FEATURES]))
    shift = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.try_divide(F.abs(F.col(f"{c}_m") - F.col(f"{c}_t")), F.col(f"{c}_s")).alias("shift")) for c in FEATURES])).alias("x")).select("x.*")
    gain = i.groupBy("feature").agg(F.avg("gain").alias("importance"))
    return shift.join(F.broadcast(gain), "feature").select("feature", r4(F.col("shift")).alias("shift"), r4(F.col("importance")).alias("importance"), r4(F.col("shift") * F.col("importance")).alias("danger")).orderBy(F.col("danger").desc(), "feature").limit(10)
