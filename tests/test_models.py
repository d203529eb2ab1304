import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyhouse.ml import boosting, forecast, models
from tallyhouse.plans import learning


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(1)
    data = [
        (rng.choice(["online", "in_store"]), rng.randrange(24), rng.randrange(7), rng.random() * 30, 1 + rng.randrange(8), rng.random() * 5)
        for _ in range(600)
    ]
    df = spark.createDataFrame(data, "channel string, arrival_hour int, day_of_week int, browsing_duration double, basket_size int, queue_wait_time double")
    return df.withColumn("completed", F.col("basket_size") + (F.col("channel") == "online").cast("int") > 4)


def test_classifier_on_separable_data(spark, visits):
    spec = models.MODELS["conversion"]
    data = models.prepare(spec, visits)
    train, test = models.split(spec, data)
    assert train.count() + test.count() == data.count() and test.count() > 60
    model = models.fit(spec, train, trees=3)
    quality = {r["metric"]: r["value"] for r in models.evaluate(spec, model, test).collect()}
    assert quality["roc_auc"] > 0.9 and quality["accuracy"] > 0.9 and 0 <= quality["f1"] <= 1
    strict = models.predict(spec, model, test, threshold=0.99)
    assert strict.filter("probability < 0.99 AND prediction = 1").count() == 0
    top = models.feature_importance(spec, model, spark)
    assert top.first()["feature"] == "basket_size" and top.count() == 5
    with pytest.raises(Exception):
        models.predict(spec, model, test.withColumn("channel", F.lit("new"))).collect()


def test_regressor_is_never_negative_and_unseen_labels_take_the_first_class(spark):
    spec = models.MODELS["clv"]
    rng = random.Random(2)
    data = [(float(d), c, float(a), 10, rng.choice(["High", "Low"]), float(-50 + c)) for d, c, a in ((rng.randrange(900), rng.randrange(9), rng.random() * 90) for _ in range(200))]
    df = spark.createDataFrame(data, "days_since_join double, purchase_count int, avg_order_value double, loyalty_points int, value_tier string, total_spend double")
    train = models.prepare(spec, df)
    model = models.fit(spec, train, trees=2)
    scored = models.clv_segments(spec, model, train.withColumn("value_tier", F.lit("Unknown")))
    assert scored.filter("prediction < 0").count() == 0
    assert {r["segment"] for r in scored.select("segment").distinct().collect()} == {"low"}
    same = models.predict(spec, model, train.withColumn("value_tier", F.lit("High"))).select("prediction")
    assert rows(scored.select("prediction")) == rows(same)


def test_label_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "x string")
    encoder = models.label_encoder(df, "x")
    new = spark.createDataFrame([("c",), ("a",), ("zzz",)], "x string")
    assert [r["x_index"] for r in models.label_encode(new, encoder).collect()] == [2, 0, 0]


def test_train_all_reports_and_saves(small, tmp_path):
    report = models.train_all(small, str(tmp_path), "inventory", trees=2, validate=False)
    got = rows(report)
    assert {r[0] for r in got} == {"stockout", "lead_time"} and {r[1] for r in got} == {"trained"}
    spec = models.MODELS["lead_time"]
    again = models.load(str(tmp_path), "lead_time")
    assert models.predict(spec, again, models.prepare(spec, spec.dataset(small))).filter("prediction < 0").count() == 0


def test_cross_validation(visits):
    spec = models.MODELS["conversion"]
    mean, deviation = models.cross_validate(spec, models.placed(spec, models.prepare(spec, visits)), trees=1, folds=2)
    assert mean > 0.7 and 0 <= deviation < 0.3


@pytest.mark.parametrize("kind", ["classifier", "regressor"])
def test_folds_are_grown_as_spark_ml_grows_them(spark, visits, kind):
    spec = models.MODELS["conversion"] if kind == "classifier" else dataclasses.replace(models.MODELS["order_value"], target="queue_wait_time", numeric=("basket_size", "arrival_hour", "day_of_week", "browsing_duration"))
    rows = models.placed(spec, models.prepare(spec, visits))
    scores = []
    for k in range(2):
        inside = F.pmod(F.col(models.PLACE), F.lit(2)) == k
        model = models.fit(spec, models.sampled(rows.filter(~inside)), 4, rows)
        scores.append(models.measures(spec, model, rows.filter(inside))[spec.cv_metric])
    mean, deviation = models.cross_validate(spec, rows, trees=4, folds=2)
    assert abs(mean - sum(scores) / 2) < 1e-9 and abs(deviation - abs(scores[0] - scores[1]) / 2) < 1e-9


def test_more_trees_take_no_more_jobs_of_a_cross_validation(spark, visits):
    spec = models.MODELS["conversion"]
    rows = models.placed(spec, models.prepare(spec, visits))

    def jobs(trees):
        last = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup())
        before = last()
        models.cross_validate(spec, rows, trees=trees, folds=2)
        return last() - before

    assert jobs(8) - jobs(2) < 10  # 6 trees of 2 folds were up to 60 jobs


@pytest.mark.parametrize("bins", [4, 256])
def test_trees_split_at_the_best_point(bins):
    x = np.array([[float(k % 10), 7.0] for k in range(100)])
    y = (x[:, 0] >= 5).astype(float) * 3
    parts = boosting.ensemble(x, y, False, 1, 2, 0.1, bins)
    assert parts[0][0].tolist() == [0, 0, 0] and np.allclose(boosting.score(x, *parts), y, atol=1.5 if bins == 4 else 1e-12)
    assert len(boosting.cut_points(x[:, 1], bins)) == 0 and len(boosting.cut_points(x[:, 0], bins)) == min(9, bins - 1)
    same = boosting.ensemble(x, np.ones(100), True, 3, 2, 0.1, bins)  # one class
    assert np.ptp(boosting.score(x, *same)) < 1e-12


def test_split_keeps_the_share_of_every_class(spark):
    spec = models.MODELS["churn"]
    rows = spark.range(1000).select(
        *[F.lit(1.0).alias(c) for c in spec.numeric], F.lit("High").alias("value_tier"), (F.col("id") < 37).cast("double").alias("label"), F.lit(True).alias("complete"))
    train, test = models.split(spec, rows.repartition(5))  # equal rows but for the class
    assert dict(test.groupBy("label").count().collect()) == {1.0: 7, 0.0: 193}
    assert dict(train.groupBy("label").count().collect()) == {1.0: 30, 0.0: 770}
    some = models.sampled(train, 80)
    assert dict(some.groupBy("label").count().collect()) == {1.0: 3, 0.0: 77}
    places = [r[models.PLACE] for r in models.placed(spec, rows).filter("label = 1").collect()]
    assert sorted(places) == list(range(1, 38))


@pytest.mark.parametrize("digits", [1, 3, 12])
def test_auc_with_ties_by_brute_force(spark, digits):
    rng = random.Random(digits)
    data = [(round(rng.random() ** (2 - y), digits), float(y)) for y in (rng.random() < 0.3 for _ in range(300))]
    found = models.rank_sum_auc(spark.createDataFrame(data, "probability double, label double").repartition(7))
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(found - want) < 1e-12


def test_reports_of_both_kinds(small):
    for name, extra in (("churn", "cv_roc_auc_std"), ("clv", "cv_mae_std")):
        spec = models.MODELS[name]
        found = models.train(spec, spec.dataset(small), trees=2)
        figures = dict(models.report(found, trees=1))
        assert extra in figures and figures["train_samples"] + figures["test_samples"] == found.rows.count()
        assert all(models.in_range(m, v) for m, v in figures.items())


def test_too_few_rows_are_skipped(small, tables, tmp_path):
    few = tables(inventory_events=small["inventory_events"].limit(5), supplier_deliveries=small["supplier_deliveries"].limit(0))
    assert {r[1] for r in rows(models.train_all(few, str(tmp_path), "inventory", trees=1))} == {"skipped"}


def test_forecast_follows_trend_and_day(spark):
    data = [(h, d, "online", 10 + d * 24 + h + (5 if h == 12 else 0)) for d in range(7) for h in range(24)]
    demand = spark.createDataFrame([*data, (0, 0, "bopis", 1)], "hour_of_day int, day_of_week int, channel string, y bigint")
    got = forecast.forecast(demand, periods=24).collect()
    assert {r["channel"] for r in got} == {"online"} and len(got) == 24  # bopis has too few hours
    by_hour = sorted(got, key=lambda r: r["ds"])
    assert abs(by_hour[12]["yhat"] - by_hour[11]["yhat"]) > 4
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in got)
    assert all(abs(r["yhat"] - (r["trend"] + r["daily"] + r["weekly"])) < 1e-5 for r in got)
    errors = forecast.cross_validation(demand).first()
    assert errors["points"] == 144 and errors["mae"] >= 0


def test_rows_without_a_feature_get_no_prediction_but_stay(spark):
    spec = models.MODELS["conversion"]
    rows = [("online" if k % 2 else "store", k % 24, k % 7, float(k % 30), k % 5 + 1, 1.0, k % 3 == 0) for k in range(200)]
    names = "channel string, arrival_hour int, day_of_week int, browsing_duration double, basket_size int, queue_wait_time double, completed boolean"
    df = spark.createDataFrame([*rows, ("online", None, 1, 1.0, 1, 1.0, True), (None, 3, 1, 1.0, 1, 1.0, False)], names)
    ready = models.prepare(spec, df)
    assert ready.count() == 202 and models.learnable(ready).count() == 200
    fitted = models.fit(spec, models.learnable(ready), trees=2)
    found = models.predict(spec, fitted, ready).collect()
    assert len(found) == 202
    assert sum(r.prediction is None and r.probability is None for r in found) == 2
    assert sum(r.arrival_hour is None for r in found) == 1 and sum(r.channel is None for r in found) == 1


def test_supplier_names_keep_apart(spark):
    spec = models.MODELS["lead_time"]
    suppliers = [f"supplier {k}" for k in range(3000)] + [str(k) for k in range(3000)]
    df = spark.createDataFrame([(s, 1, 1, 1.0, 2.0) for s in suppliers], "supplier_id string, order_quantity int, day_of_week int, expected_lead_time_days double, actual_lead_time_days double")
    assert models.prepare(spec, df).select("supplier_id").distinct().count() == 6000


def test_registered_training_is_the_whole_one(small, monkeypatch):
    asked = []

    def fit(spec, rows, trees=None, labelled=None):
        asked.append((spec.name, trees))
        raise ValueError("seen")

    monkeypatch.setattr(models, "fit", fit)
    monkeypatch.setattr(models, "_forecast_one", lambda *_: [])
    monkeypatch.setattr(learning, "trained", learning.Trained())
    found = rows(learning.MODELS["P-21_train_all"](small))
    assert {r[1] for r in found} == {"failed"} and sorted(asked) == sorted((name, 100) for name in models.MODELS)
    assert models.report.__defaults__[:2] == (100, True) and models.FOLDS == 5


def test_a_fit_learns_from_all_rows_of_its_part(spark, monkeypatch):
    spec = models.MODELS["stockout"]
    columns = [(F.col("id") % (k + 2)).cast("int").alias(c) for k, c in enumerate(spec.numeric)]
    data = spark.range(8000).select(*columns, (F.col("id") % 16 < 1).alias("stockout_occurred"))
    asked = []
    whole = models.fit
    monkeypatch.setattr(models, "fit", lambda spec, rows, *rest: asked.append(rows) or whole(spec, rows, *rest))
    found = models.train(spec, data, trees=1)
    assert asked[0].count() == found.train_samples == 6400 and asked[0].filter("label = 1").count() == 400


@pytest.mark.parametrize("bins", [3, 8, 32])
def test_thresholds_are_those_of_all_values(spark, bins):
    rng = np.random.default_rng(bins)
    x = np.stack([rng.random(500), np.floor(rng.random(500) * 7), np.where(rng.random(500) < 0.6, 5.0, np.floor(rng.random(500) * 90)), np.full(500, 2.0), rng.normal(size=500) ** 3], 1)
    df = spark.createDataFrame(x.tolist(), ["a", "b", "c", "d", "e"]).repartition(5)
    for found, column in zip(models.thresholds(df, df.columns, bins), x.T, strict=True):
        assert np.array_equal(found, boosting.cut_points(column, bins))


def test_thresholds_of_a_large_fit_come_from_all_rows(spark, monkeypatch):
    spec = dataclasses.replace(models.MODELS["clv"], categorical=())
    n = 4000  # one row in 1000 alone has what the label follows; Spark ML would look at 2 ** 2 rows, 10 000 at least
    first = (F.col("id") % 1000 == 0).cast("double")
    data = spark.range(n).select(*[(first if k == 0 else F.xxhash64("id", F.lit(k)) / 1e18).alias(c) for k, c in enumerate(spec.numeric)], (first * 50).alias("label"))
    plain = models.fit(spec, data, trees=2)
    monkeypatch.setattr(models, "thresholds", lambda *a, kept=models.thresholds: asked.append(1) or kept(*a))
    monkeypatch.setattr(models, "BINS", 32)
    asked = []
    model = models.fit(spec, data, trees=2)
    assert asked and model.stages[-1].getMaxBins() ** 2 > n and model.stages[-1].getMaxIter() == 2
    scored = models.predict(spec, model, data)
    assert scored.columns == models.predict(spec, plain, data).columns
    assert scored.filter("abs(prediction - label) > 1e-9").count() == 0


def test_folds_learn_from_all_other_rows(spark, monkeypatch):
    spec = models.MODELS["stockout"]
    columns = [(F.col("id") % (k + 2)).cast("int").alias(c) for k, c in enumerate(spec.numeric)]
    rows = models.placed(spec, models.prepare(spec, spark.range(9000).select(*columns, (F.col("id") % 16 < 1).alias("stockout_occurred"))))
    asked, fit = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda rows, *rest: asked.append(rows) or fit(rows, *rest))
    models.cross_validate(spec, rows, trees=1, folds=4)
    sizes = {r["key"]: r["count"] for r in asked[0].groupBy("key").count().collect()}
    assert sum(sizes.values()) == 27000 and len(sizes) == 4 and min(sizes.values()) > 6700  # three of four folds, in shares of two strata


@pytest.mark.parametrize("name", ["conversion", "order_value"])
def test_large_folds_are_fitted_by_spark_ml_with_the_same_figures(spark, visits, monkeypatch, name):
    spec = models.MODELS[name] if name == "conversion" else dataclasses.replace(models.MODELS[name], target="queue_wait_time", numeric=("basket_size", "arrival_hour", "day_of_week", "browsing_duration"))
    rows = models.placed(spec, models.prepare(spec, visits))
    in_tasks = models.cross_validate(spec, rows, trees=3, folds=2)
    monkeypatch.setattr(boosting, "fit", None)
    assert np.allclose(models.cross_validate(spec, rows, trees=3, folds=2, most=599), in_tasks, rtol=0, atol=1e-9)


def test_training_draws_no_sample(small, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "sampled", None)
    report = rows(models.train_all(small, str(tmp_path), "inventory", trees=1))
    assert {(r[0], r[1]) for r in report} == {("stockout", "trained"), ("lead_time", "trained")}
    assert {r[2] for r in report if r[2].startswith("cv_")} == {"cv_roc_auc_mean", "cv_roc_auc_std", "cv_mae_mean", "cv_mae_std"}
