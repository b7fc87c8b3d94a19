"""Trainers against plain Python: gradients, searches, forests, folds, files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import isolation, linear, models, sampling, scoring, search
from tidemark.sources import sinks


def points(spark, n=300, groups=20, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, i % groups, int(a + 0.5 * b + rng.gauss(0, 0.3) > 0.8), a, b))
    return rows, spark.createDataFrame(rows, "event_id long, g int, y int, a double, b double")


def test_focal_pull_is_the_derivative_of_the_loss(spark):
    ys, raws = (0, 1), (-3.0, -0.4, 0.0, 1.7)
    d = spark.createDataFrame([(y, r) for y in ys for r in raws], "y int, raw double")

    def loss(y, r):
        p = 1 / (1 + math.exp(-r))
        pt = p if y else 1 - p
        return -0.25 * (1 - pt) ** 2 * math.log(pt)

    for r in d.withColumn("g", linear.focal_pull("y")(d)).collect():
        assert r["g"] == pytest.approx((loss(r["y"], r["raw"] + 1e-5) - loss(r["y"], r["raw"] - 1e-5)) / 2e-5, abs=1e-6)


def test_list_pull_against_softmax(spark):
    rows, d = points(spark, 60, 7)
    d = d.withColumn("raw", F.col("a") * 2)
    got = {r["event_id"]: r["g2"] for r in d.withColumn("g2", linear.list_pull("y", "g")(d)).collect()}
    for g in range(7):
        mine = [r for r in rows if r[1] == g]
        gains, total = sum(r[2] for r in mine), sum(math.exp(2 * r[3]) for r in mine)
        for r in mine:
            assert got[r[0]] is None if not gains else got[r[0]] == pytest.approx(math.exp(2 * r[3]) / total - r[2] / gains)


def test_descent_ranks_and_separates(spark):
    _, d = points(spark)
    x = linear.standardized(d, ("a", "b"))
    for pull, rate in ((linear.focal_pull("y"), 4.0), (linear.list_pull("y", "g"), 20.0)):
        w = linear.descend(x, pull, 3, 15, rate)
        out = x.withColumn("score", linear.linear(w))
        assert w[0] > w[1] > 0
        assert scoring.roc_auc(out, "y", "score").first()["auc"] > 0.95 and linear.ndcg(out, "y", "score", "g", "event_id").first()["ndcg"] > 0.9
    start = linear.focal_loss(x.withColumn("raw", F.lit(0.0)), "y")
    w = linear.descend(x, linear.focal_pull("y"), 3, 15, 4.0)
    assert linear.focal_loss(x.withColumn("raw", linear.linear(w)), "y") < 0.6 * start
    assert linear.descend(x.limit(0), linear.list_pull("y", "g"), 3, 3, 1.0) == [0.0, 0.0, 0.0]


def test_ndcg_of_known_lists(spark):
    d = spark.createDataFrame([(1, 1, 1, 0.1), (1, 2, 0, 0.9), (2, 3, 1, 0.9), (2, 4, 0, 0.1), (3, 5, 0, 0.5)], "g int, event_id long, y int, s double")
    r = linear.ndcg(d, "y", "s", "g", "event_id").first()
    assert r["groups"] == 2 and r["ndcg"] == pytest.approx((1 / math.log2(3) + 1) / 2)


def test_search_against_a_grid(spark):
    rows, d = points(spark, 200)

    def ap(w):
        order = sorted(((w[0] * r[3] + w[1] * r[4], r[2]) for r in rows), key=lambda x: -x[0])
        hits, total = 0, 0.0
        for k, (_, y) in enumerate(order, 1):
            hits += y
            total += y * hits / k
        return total / hits

    got = search.precisions(d, "y", ("a", "b"), [[1.0, 0.0], [0.3, 0.7]])
    assert got == pytest.approx([ap((1, 0)), ap((0.3, 0.7))])
    w, best = search.nelder_mead(d, "y", ("a", "b"), starts=3, rounds=8)
    assert best == pytest.approx(ap(w)) and best >= max(ap((i / 20, 1 - i / 20)) for i in range(21)) - 5e-3


def test_search_sorts_ranges_of_any_scores(spark, monkeypatch):
    """Many ranges and pieces, ties, nulls, NaN and labels without a value: as the aggregates of scores have them."""
    monkeypatch.setattr(search, "RANGE_ROWS", 40)
    monkeypatch.setattr(search, "PIECE_ROWS", 70)
    rng = random.Random(8)
    odd = [None, float("nan"), float("inf"), 0.0, -0.0]
    rows = [(rng.choice((0, 0, 1, None)), rng.choice(odd) if i % 9 == 0 else rng.randrange(30) / 8, rng.gauss(0, 1) if i % 3 else 0.5) for i in range(900)]
    d = spark.createDataFrame(rows, "y int, a double, b double").repartition(3)
    points = [[1.0, 0.0], [0.5, 0.25], [-2.0, 0.125], [0.0, 0.0]]
    got = search.precisions(d, "y", ("a", "b"), points)
    for p, ap in zip(points, got):
        blend = F.lit(0.0) + F.lit(p[0]) * F.col("a") + F.lit(p[1]) * F.col("b")
        assert ap == pytest.approx(scoring.average_precision(d.withColumn("s", blend), "y", "s").first()["ap"], rel=1e-12)
    assert search.precisions(d.limit(0), "y", ("a", "b"), points[:2]) == [0.0, 0.0] == search.precisions(d.withColumn("y", F.lit(0)), "y", ("a", "b"), points[:2])


def test_search_scores_no_point_that_it_does_not_need(spark, monkeypatch):
    _, d = points(spark, 100)
    asked, true = [], search.precisions
    monkeypatch.setattr(search, "precisions", lambda df, y, scores, p, *more: asked.append(len(p)) or true(df, y, scores, p, *more))
    search.nelder_mead(d, "y", ("a", "b"), starts=3, rounds=4)
    # the corners, then in each round the reflections and at most one more point of each start, and corners of simplices that shrink
    assert asked[0] == 9 and sum(asked[1:]) <= 4 * 3 * 4 and sum(k <= 3 for k in asked[1:]) >= 8


def test_isolation_sets_outliers_apart(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [(1000, 9.0, 9.0), (1001, -8.0, 9.0), (1002, None, None)]
    d = spark.createDataFrame(rows, "event_id long, a double, b double")
    model = isolation.forest(d, ("a", "b"))
    got = {r["event_id"]: r["anomaly"] for r in isolation.anomaly(d, model, ("a", "b")).collect()}
    assert {1000, 1001} == set(sorted(got, key=lambda k: -got[k])[:2]) and all(0 < v < 1 for v in got.values()) and got[1002] < 0.6

    def depth(tree, row, k=0):
        return k + tree[0] if len(tree) == 1 else depth(tree[2 if row[tree[0]] < tree[1] else 3], row, k + 1)

    for id_, a, b in rows[:50]:
        mean = sum(depth(t, (a, b)) for t in model) / len(model)
        assert got[id_] == pytest.approx(2 ** (-mean / isolation.usual(isolation.SAMPLE)))


def test_out_of_fold_never_sees_its_fold(spark):
    """Labels are random but for a feature that tells each row from all others: a model that saw a row would know its label."""
    rng = random.Random(5)
    rows = [(i, float(i), rng.randrange(2)) for i in range(240)]
    d = models.assembled(spark.createDataFrame(rows, "event_id long, a double, y int"), ("a",), "y")
    out = models.out_of_fold(d, "y", k=3)
    assert out.count() == 240 and out.select("event_id").distinct().count() == 240
    blind = scoring.roc_auc(out.withColumn("y", F.col("y").cast("int")), "y", "oof").first()["auc"]
    assert 0.35 < blind < 0.65
    seen = models.predict(models.learner("gbt", "y", 1).fit(d), d, "p")
    assert scoring.roc_auc(seen.withColumn("y", F.col("y").cast("int")), "y", "p").first()["auc"] > blind + 0.1


def test_ensemble_on_known_splits(spark):
    """A label that one cut decides: every tree finds it."""
    d = models.assembled(spark.createDataFrame([(i, float(i % 40), int(i % 40 >= 25)) for i in range(400)], "event_id long, a double, y int"), ("a",), "y")
    for kind in ("gbt", "forest"):
        out = models.ensemble(d, d, "y", kind=kind, seeds=(1, 2))
        assert out.filter((F.col("score") > 0.5) != (F.col("y") == 1)).count() == 0
    path = models.saved(m := models.learner("gbt", "y", 1, trees=2).fit(d), spark, "one")
    again = type(m).load(path)
    a, b = (models.predict(x, d, "p").orderBy("event_id").select("p").collect() for x in (m, again))
    assert a == b


def test_tables_are_made_once_for_each_input(spark, tmp_path):
    made = []
    spark.range(5).write.parquet(f"{tmp_path}/a")
    build = lambda p: lambda: made.append(p) or spark.read.parquet(p).groupBy().count()
    first = sinks.materialize_once(spark, "t", build(f"{tmp_path}/a"))
    spark.range(9).write.parquet(f"{tmp_path}/b")
    assert first.first()[0] == 5 and sinks.materialize_once(spark, "t", build(f"{tmp_path}/b")).first()[0] == 9
    assert sinks.materialize_once(spark, "t", build(f"{tmp_path}/a")).inputFiles() == first.inputFiles()


def test_quantiles_and_orders_of_tied_values(spark):
    rows = [(i, i % 3, float(i % 4) if i % 7 else None) for i in range(200)]
    d = spark.createDataFrame(rows, "event_id long, g int, v double")
    qs = {"q10": 0.1, "q50": 0.5, "q95": 0.95, "q0": 0.0, "q1": 1.0}
    want = d.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(k) for k, q in qs.items()]).orderBy("g").collect()
    assert scoring.quantiles(d, "v", qs, by=("g",)).orderBy("g").collect() == want
    assert tuple(scoring.quantiles(d.limit(0), "v", {"q": 0.5}).first()) == (None,)
    k = [(r["event_id"], r["k"]) for r in scoring.ordinal(d, "v", "event_id", "k").orderBy("k").collect()]
    assert [x for _, x in k] == list(range(1, 201)) and [i for i, _ in k] == [r[0] for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))]
    by = {r["g"]: r["ap"] for r in scoring.average_precision_by(d.withColumn("y", (F.col("event_id") % 5 == 0).cast("int")).filter("v is not null"), "y", "v", "g").collect()}
    for g in range(3):
        one = d.withColumn("y", (F.col("event_id") % 5 == 0).cast("int")).filter(f"v is not null and g = {g}")
        assert by[g] == pytest.approx(scoring.average_precision(one, "y", "v").first()["ap"])
    assert [r[0] for r in sampling.shuffled(spark.range(50).withColumnRenamed("id", "event_id")).collect()] != list(range(50))
