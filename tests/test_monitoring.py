"""Features, drift, retraining, model verdicts, forecast and audit."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendwright.functions.hashing import standard_normal
from spendwright.operators import audit as A
from spendwright.operators import drift as D
from spendwright.operators import features as X

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(u, day(i), float(i + (100 if u.startswith("SKU_2") else 0)))
            for u in ("SKU_1__FC_US_EAST", "SKU_2__FC_Berlin") for i in range(40)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double")


def test_lags_do_not_leak(series):
    rows = X.lag_rolling_features(series).where("unique_id like 'SKU_1%'").orderBy("ds").collect()
    assert rows[0].lag_1 is None and rows[0].rolling_mean_7 is None
    assert rows[1].lag_1 == 0.0 and rows[1].rolling_mean_7 == 0.0 and rows[1].rolling_std_7 is None
    assert rows[30].lag_28 == 2.0
    past = np.arange(23, 30)
    assert rows[30].rolling_mean_7 == pytest.approx(past.mean())
    assert rows[30].rolling_std_7 == pytest.approx(past.std(ddof=1))
    assert rows[0].day_of_week == 0 and rows[0].month == 1  # a Monday
    with pytest.raises(ValueError):
        X.lag_rolling_features(series.drop("y"))


def test_joins(spark, series):
    momentum = spark.createDataFrame([(day(i), float(i)) for i in range(10)] + [(day(0), 2.0)], "ds date, net_momentum double")
    climate = spark.createDataFrame([(day(0), "US_EAST", 5.0, 60.0), (day(0), "UNKNOWN", 1.0, 2.0)],
                                    "ds date, region string, temperature_celsius double, humidity_pct double")
    stock = spark.createDataFrame([(day(0), "SKU_1", "FC_US_EAST", day(9)), (day(0), "SKU_1", "FC_US_EAST", day(4))],
                                  "snapshot_date date, sku_id string, fc_id string, expiry_date date")
    rows = X.materialize_features(series, momentum, climate, stock).orderBy("unique_id", "ds").collect()
    assert len(rows) == 80
    first, fourth, other = rows[0], rows[3], rows[40]
    assert first.social_momentum_t3 is None and fourth.social_momentum_t3 == 1.0
    assert first.temperature == 5.0 and first.days_to_expiry == 4.0
    assert other.temperature == 1.0 and other.days_to_expiry is None
    bare = X.materialize_features(series)
    assert bare.where("days_to_expiry is not null or humidity is not null or social_momentum_t3 is not null").count() == 0


def test_slice_and_snapshot(spark, series):
    ids = spark.createDataFrame([("SKU_1__FC_US_EAST",), ("gone",)], "unique_id string")
    cut = X.training_slice(series, ids, day(3), day(5))
    assert [r.ds for r in cut.orderBy("ds").collect()] == [day(3), day(4), day(5)]
    assert X.training_slice(series, ["SKU_2__FC_Berlin"]).count() == 40
    latest = {r.unique_id: r.y for r in X.latest_snapshot(series, ids).collect()}
    assert latest == {"SKU_1__FC_US_EAST": 39.0, "gone": None}


@pytest.fixture(scope="module")
def normals(spark):
    return spark.range(500).select(standard_normal(F.col("id"), seed=1).alias("a"), F.lit("text").alias("t"),
                                   standard_normal(F.col("id"), seed=2).alias("b"))


def test_ks_distance_equals_numpy(normals):
    moved = normals.withColumn("a", F.col("a") + 1.0)
    rows = {r.feature: r for r in D.data_drift_ks(normals, moved).collect()}
    assert set(rows) == {"a", "b"}
    x, y = (np.sort([r.a for r in f.collect()]) for f in (normals, moved))
    both = np.concatenate([x, y])
    d = np.max(np.abs(np.searchsorted(x, both, "right") / 500 - np.searchsorted(y, both, "right") / 500))
    assert rows["a"].statistic == pytest.approx(d)
    assert rows["a"].action == "AUTO_RETRAIN" and rows["b"].action == "OK" and rows["b"].statistic == 0.0


def test_ks_skips_small_samples_and_nulls(spark, normals):
    one = spark.createDataFrame([(1.0, None), (float("nan"), 2.0)], "a double, b double")
    assert D.data_drift_ks(normals, one).count() == 0


def test_psi(spark, normals):
    same = D.prediction_drift_psi(normals, normals, "a").first()
    assert same.psi == pytest.approx(0.0) and same.action == "OK"
    moved = normals.withColumn("a", F.col("a") + 1.0)
    row = D.prediction_drift_psi(normals, moved, "a").first()
    x, y = (np.array([r.a for r in f.collect()]) for f in (normals, moved))
    edges = np.linspace(x.min(), x.max(), 11)
    edges[0] -= 1e-6
    edges[-1] += 1e-6
    r, c = (np.histogram(v, edges)[0] for v in (x, y))
    r, c = r / (r.sum() + 1e-6), c / (c.sum() + 1e-6)
    r, c = np.where(r == 0, 1e-6, r), np.where(c == 0, 1e-6, c)
    assert row.psi == pytest.approx(np.sum((c - r) * np.log(c / r)), rel=1e-9)
    assert row.action == "AUTO_RETRAIN"
    flat = spark.createDataFrame([(2.0,)] * 5, "a double")
    assert D.prediction_drift_psi(flat, moved, "a").first().psi == 0.0


def test_serving_drift(normals):
    moved = normals.withColumn("a", F.col("a") * 3.0)
    rows = {r.feature: r for r in D.serving_drift(normals, moved).collect()}
    assert rows["a"].drift_detected and rows["a"].psi_drift and not rows["b"].drift_detected
    with pytest.raises(ValueError):
        D.population_stability(normals, moved, bins="other")


def _history(spark, values, model="m", reset=()):
    rows = [(model, day(i), v, i in reset) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "model_id string, ds date, mape double, reset boolean")


@pytest.mark.parametrize(
    "values, count, action",
    [([0.25] * 10, 10, "AUTO_RETRAIN"), ([0.1] * 10, 0, "OK"), ([0.25] * 7, 7, "AUTO_RETRAIN"), ([0.25] * 6, 6, "ALERT"),
     ([0.25, 0.1] * 5, 0, "OK"), ([0.1, 0.25], 1, "ALERT"), ([0.2] * 9, 0, "OK")],
)
def test_concept_drift(spark, values, count, action):
    row = D.concept_drift(_history(spark, values)).first()
    assert (row.consecutive_count, row.action) == (count, action)
    assert row.statistic == pytest.approx(np.mean(values[-7:]))
    last = D.retrain_history(_history(spark, values)).orderBy(F.desc("ds")).first()
    assert last.consecutive_count == count


def test_retrain_history_reset(spark):
    rows = D.retrain_history(_history(spark, [0.3] * 10, reset={4}), reset_before="reset").orderBy("ds").collect()
    assert [r.consecutive_count for r in rows] == [1, 2, 3, 4, 1, 2, 3, 4, 5, 6]
    assert not any(r.should_retrain for r in rows)


def test_retrain_reasons(spark):
    concept = D.concept_drift(_history(spark, [0.3] * 8, "bad").unionByName(_history(spark, [0.1] * 8, "good")))
    drift = spark.createDataFrame([("f1", "AUTO_RETRAIN"), ("f0", "AUTO_RETRAIN"), ("f2", "ALERT")], "feature string, action string")
    rows = {r.model_id: r for r in D.retrain_verdict(concept, drift).collect()}
    assert rows["bad"].reason == "CONCEPT_AND_DATA_DRIFT" and rows["good"].reason == "DATA_DRIFT_AUTO_RETRAIN"
    assert rows["bad"].triggering_features == ["f0", "f1"]
    rows = {r.model_id: r for r in D.retrain_verdict(concept).collect()}
    assert rows["bad"].reason == "CONCEPT_DRIFT_MAPE" and rows["good"].reason == "OK" and not rows["good"].should_retrain


def test_relative_and_monitoring(spark):
    base = spark.createDataFrame([("a", 0.118), ("b", 0.118)], "model_id string, mape double")
    now = spark.createDataFrame([("a", 0.125), ("b", 0.2)], "model_id string, mape double")
    rows = D.relative_mape_drift(now, base).withColumn("f", F.lit(None).cast("boolean")).withColumn("p", F.col("drifted"))
    got = {r.model_id: r for r in D.monitoring_verdict(rows, "drifted", "f", "p").collect()}
    assert got["a"].next_step == "no_action" and got["a"].reasons == ""
    assert got["b"].reasons == "MAPE drift, prediction drift"


def _metrics(spark, champion, challenger):
    rows = [("m", "champion", k, v) for k, v in champion.items()] + [("m", "challenger", k, v) for k, v in challenger.items()]
    return spark.createDataFrame(rows, "model_id string, role string, metric string, value double")


@pytest.mark.parametrize(
    "champion, challenger, verdict, comparison",
    [({"mape": 0.2, "auuc": 0.6}, {"mape": 0.1, "auuc": 0.7}, "promoted", "promote"),
     ({"mape": 0.1, "auuc": 0.7}, {"mape": 0.2, "auuc": 0.6}, "retained", "retain"),
     ({"mape": 0.1, "auuc": 0.6}, {"mape": 0.1, "auuc": 0.7}, "retained", "mixed"),
     ({"mape": 0.1}, {"auuc": 0.7}, "retained", "mixed")],
)
def test_model_verdicts(spark, champion, challenger, verdict, comparison):
    metrics = _metrics(spark, champion, challenger)
    assert D.champion_challenger(metrics).first().verdict == verdict
    assert D.model_comparison(metrics).first().verdict == comparison


def test_error_words_anywhere_in_the_name(spark):
    metrics = _metrics(spark, {"val_RMSE": 2.0}, {"val_RMSE": 1.0})
    assert D.champion_challenger(metrics).first().verdict == "promoted"


def test_forecast_routes(spark):
    rows = [("new", day(i), 5.0 + i) for i in range(10)] + [("sparse", day(i), float(i % 2)) for i in range(80)]
    rows += [("old", day(i), 10.0) for i in range(80)]
    df = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    got = {(r.unique_id, r.step): r for r in D.series_forecast(df, 3).collect()}
    assert {k[0]: r.model_used for k, r in got.items()} == {"new": "chronos_zs", "sparse": "sarimax", "old": "lightgbm"}
    assert got["new", 2].point_forecast == pytest.approx(9.5 + 2)
    assert got["new", 1].routing_reason == "Cold start: only 10 days of history (<60)"
    assert got["sparse", 1].routing_reason == "Intermittent demand: 50% zero days (>30%)"
    assert got["old", 3].lower_90 == got["old", 3].upper_90 == 10.0 and got["old", 1].ds == day(80)


def test_audit(spark):
    log = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, h), f"u{h % 2}", f"drift.{h % 3}", "success" if h % 4 else "failure") for h in range(12)],
        "timestamp timestamp, user_name string, action string, outcome string")
    rows = A.audit_recent(log, 2, user="u0", action="drift").collect()
    assert [r.timestamp.hour for r in rows] == [10, 8]
    stats = {(r.metric, r.name): r.value for r in A.audit_stats(log).collect()}
    assert stats["total_entries", None] == 12 and stats["unique_users", None] == 2
    assert stats["outcome", "failure"] == 3 and stats["top_action", "drift.0"] == 4


@pytest.mark.parametrize(
    "method, path, action",
    [("GET", "/api/forecasts/SKU_001", "forecast.read"), ("POST", "/api/pipelines/run", "pipeline.run"),
     ("GET", "/api/drift/status", "drift.read"), ("DELETE", "/experiments/1", "experiment.delete"),
     ("GET", "/api", "api.get"), ("OPTIONS", "/costs", "costs.options"), ("POST", "/pipelines", "pipelines.create")],
)
def test_derive_action(spark, method, path, action):
    df = spark.createDataFrame([(method, path)], "method string, path string")
    assert df.select(A.derive_audit_action(F.col("method"), F.col("path"))).first()[0] == action
