"""Queries of features, drift, retraining and the audit log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spendwright.operators import audit as A
from spendwright.operators import drift as D
from spendwright.operators import features as X
from spendwright.plans.registry import query
from spendwright.sources import files
from spendwright.sources.session import new_path
from spendwright.sources.views import Tables
from spendwright.streaming.keyed import KeyedTable

# ---------------------------------------------------------------- features


def _rolling_sql(source: str) -> str:
    lags = ", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in X.LAGS)
    rolling = ", ".join(
        f"avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS rolling_mean_{n}, "
        f"stddev_samp(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) "
        f"AS rolling_std_{n}"
        for n in X.ROLLING_WINDOWS
    )
    return (
        f"SELECT unique_id, ds, y, {lags}, {rolling}, isodow(ds) - 1 AS day_of_week, month(ds) AS month "
        f"FROM {source} WINDOW w AS (PARTITION BY unique_id ORDER BY ds)"
    )


_LAG_COLUMNS = (
    "lag_1:4 lag_7:4 lag_14:4 lag_28:4 rolling_mean_7:4 rolling_std_7:4 rolling_mean_28:4 rolling_std_28:4 "
    "day_of_week:i month:i"
)


@query("lag_rolling_features", f"unique_id:i ds:d y:4 {_LAG_COLUMNS}", "series", _rolling_sql("series"))
def _(t: Tables):
    return X.lag_rolling_features(t["series"])


_MOMENTUM_SQL = """
dm AS (SELECT ds, avg(net_momentum) AS m FROM momentum GROUP BY ds),
sm AS (SELECT ds, lag(m, 3) OVER (ORDER BY ds) AS social_momentum_t3 FROM dm)"""


@query(
    "momentum_lag_join",
    "unique_id ds:d y:4 social_momentum_t3:4",
    "series_named momentum",
    "WITH " + _MOMENTUM_SQL.lstrip() + " SELECT s.*, social_momentum_t3 FROM series_named s LEFT JOIN sm ON s.ds = sm.ds",
)
def _(t: Tables):
    return X.momentum_lag_join(t["series_named"], t["momentum"])


_REGION_SQL = r"coalesce(nullif(regexp_extract(unique_id, 'FC_([A-Z]{2}_[A-Z_]+)$', 1), ''), 'UNKNOWN')"


@query(
    "climate_join",
    "unique_id ds:d y:4 temperature:4 humidity:4",
    "series_named climate",
    f"""SELECT s.unique_id, s.ds, y, temperature_celsius AS temperature, humidity_pct AS humidity
FROM (SELECT *, {_REGION_SQL} AS region FROM series_named) s LEFT JOIN climate c ON s.ds = c.ds AND s.region = c.region""",
)
def _(t: Tables):
    return X.climate_join(t["series_named"], t["climate"])


_EXPIRY_SQL = r"""
ne AS (SELECT snapshot_date, sku_id, fc_id, date_diff('day', snapshot_date, min(expiry_date)) AS days_to_expiry
  FROM inventory GROUP BY 1, 2, 3)"""
_EXPIRY_ON = r"""ne.snapshot_date = s.ds AND ne.sku_id = regexp_extract(s.unique_id, '^(SKU_\d+)', 1)
  AND ne.fc_id = regexp_extract(s.unique_id, '__(FC_\S+)$', 1)"""


@query(
    "days_to_expiry_join",
    "unique_id ds:d y:4 days_to_expiry:0",
    "series_named inventory",
    "WITH " + _EXPIRY_SQL.lstrip() + f" SELECT s.*, days_to_expiry FROM series_named s LEFT JOIN ne ON {_EXPIRY_ON}",
)
def _(t: Tables):
    return X.days_to_expiry_join(t["series_named"], t["inventory"])


@query(
    "materialize_features",
    f"unique_id ds:d y:4 {_LAG_COLUMNS} social_momentum_t3:4 temperature:4 humidity:4 days_to_expiry:0",
    "series_named momentum climate inventory",
    "WITH " + _MOMENTUM_SQL.lstrip() + "," + _EXPIRY_SQL + f""",
f AS ({_rolling_sql("series_named")}),
s AS (SELECT *, {_REGION_SQL} AS region FROM f)
SELECT s.*, social_momentum_t3, temperature_celsius AS temperature, humidity_pct AS humidity, days_to_expiry
FROM s LEFT JOIN sm ON s.ds = sm.ds LEFT JOIN climate c ON s.ds = c.ds AND s.region = c.region
LEFT JOIN ne ON {_EXPIRY_ON}""",
)
def _(t: Tables):
    return X.materialize_features(t["series_named"], t["momentum"], t["climate"], t["inventory"])


@query(
    "training_slice",
    f"unique_id:i ds:d y:4 {_LAG_COLUMNS}",
    "series",
    "WITH f AS (" + _rolling_sql("series") + ") SELECT * FROM f WHERE ds BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' "
    "AND unique_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
)
def _(t: Tables):
    buyers = t["events"].where("event_type = 'purchase'").select(F.col("user_id").alias("unique_id"))
    return X.training_slice(_feature_store(t), buyers, dt.date(2024, 1, 8), dt.date(2024, 1, 21))


def _feature_store(t: Tables):
    """The features written by day and read back."""
    features = X.lag_rolling_features(t["series"])
    path = new_path(t.spark, "feature-store")
    files.write_features(features, path)
    return files.read_features(t.spark, path, features.schema)


@query(
    "training_days",
    f"unique_id:i ds:d y:4 {_LAG_COLUMNS}",
    "series",
    "WITH f AS (" + _rolling_sql("series") + ") SELECT * FROM f WHERE ds IN (SELECT CAST(ts AS DATE) FROM events "
    "GROUP BY 1 HAVING max(value) > (SELECT avg(m) FROM (SELECT max(value) AS m FROM events GROUP BY CAST(ts AS DATE))))",
)
def _(t: Tables):
    peaks = t["events"].groupBy(F.to_date("ts").alias("ds")).agg(F.max("value").alias("peak"))
    days = peaks.where(F.col("peak") > peaks.agg(F.avg("peak")).scalar())
    return X.training_slice(_feature_store(t), days=days)


@query(
    "feature_lookup",
    f"unique_id:i ds:d y:4 {_LAG_COLUMNS}",
    "series",
    "WITH f AS (" + _rolling_sql("series") + "), r AS (SELECT *, row_number() OVER (PARTITION BY unique_id "
    "ORDER BY ds DESC) AS i FROM f), b AS (SELECT user_id FROM events WHERE event_type = 'purchase'), "
    "ids AS (SELECT user_id AS id FROM b UNION SELECT -user_id FROM b) "
    "SELECT ids.id AS unique_id, r.* EXCLUDE (unique_id) FROM ids LEFT JOIN r ON ids.id = r.unique_id AND r.i = 1",
)
def _(t: Tables):
    """The newest features of listed series out of the keyed table; half of the ids are not in it."""
    newest = X.latest_snapshot(X.lag_rolling_features(t["series"]))
    table = KeyedTable(t.spark, new_path(t.spark, "online"), newest.schema, ["unique_id"])
    table.merge(newest, 0)
    buyers = t["events"].where("event_type = 'purchase'")
    return table.lookup(buyers.select(F.explode(F.array("user_id", -F.col("user_id"))).alias("unique_id")))


@query(
    "latest_snapshot",
    f"unique_id:i ds:d y:4 {_LAG_COLUMNS}",
    "series",
    "WITH f AS (" + _rolling_sql("series") + "), r AS (SELECT *, row_number() OVER (PARTITION BY unique_id "
    "ORDER BY ds DESC) AS i FROM f) SELECT * FROM r WHERE i = 1",
)
def _(t: Tables):
    return X.latest_snapshot(X.lag_rolling_features(t["series"]))


# ---------------------------------------------------------------- drift

# Above 10,000 values: the limiting tail at the corrected distance.
_KS_LIMIT = """CASE WHEN lam <= 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0::DOUBLE * k * k * lam * lam))))) END"""


def _long_sql(by: str) -> str:
    parts = [
        f"SELECT {by} '{feature}' AS feature, {column} AS value, {cur} AS cur FROM {view}"
        for feature, column in (("value", "value"), ("uid", "uid"))
        for view, cur in (("drift_reference", 0), ("drift_current", 1))
    ]
    return " UNION ALL ".join(parts)


def _ks_sql(by: str) -> str:
    """The distance and its tail; to 10,000 values the share of lattice paths that touch the border, diagonal by diagonal."""
    keys = f"{by}, feature" if by else "feature"
    return f"""
lo AS ({_long_sql(by + "," if by else "")}),
vc AS (SELECT {keys}, value, sum(1 - cur) AS r, sum(cur) AS c FROM lo GROUP BY {keys}, value),
cu AS (SELECT *, sum(r) OVER (PARTITION BY {keys} ORDER BY value) AS fr, sum(c) OVER (PARTITION BY {keys} ORDER BY value)
  AS fc, sum(r) OVER (PARTITION BY {keys}) AS nr, sum(c) OVER (PARTITION BY {keys}) AS nc FROM vc),
kd AS (SELECT {keys}, CAST(max(nr) AS DOUBLE) AS n_reference, CAST(max(nc) AS DOUBLE) AS n_current,
  max(abs(CAST(fr AS DOUBLE) / nr - CAST(fc AS DOUBLE) / nc)) AS statistic,
  CAST(max(nr) AS BIGINT) AS n, CAST(max(nc) AS BIGINT) AS m, CAST(max(abs(fr * nc - fc * nr)) AS BIGINT) AS reach
  FROM cu GROUP BY {keys}),
kl AS (SELECT *, x + 1 / (6 * sqrt(e)) + (x - 1) / (4 * e) AS lam FROM (SELECT *, sqrt(e) * statistic AS x
  FROM (SELECT *, n_reference * n_current / (n_reference + n_current) AS e FROM kd))),
kp AS (SELECT {keys}, n, m, reach, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS low, [0.0::DOUBLE] AS touched FROM kd
    WHERE reach > 0 AND greatest(n, m) <= 10000
  UNION ALL SELECT {keys}, n, m, reach, nk, nlow, list_transform(range(nlow, nhigh + 1), lambda i:
    (i * coalesce(touched[i - low], 1.0) + (nk - i) * coalesce(touched[i - low + 1], 1.0)) / nk)
  FROM (SELECT *, k + 1 AS nk, CAST(greatest(floor(((k + 1) * n - reach) / (n + m)) + 1, 0, k + 1 - m) AS BIGINT) AS nlow,
    CAST(least(ceil(((k + 1) * n + reach) / (n + m)) - 1, k + 1, n) AS BIGINT) AS nhigh FROM kp WHERE k < n + m)),
ks AS (SELECT kl.*, CASE WHEN greatest(kl.n, kl.m) > 10000 THEN {_KS_LIMIT} WHEN kl.reach = 0 THEN 1.0
  ELSE coalesce(t.touched[1], 1.0) END AS p_value
  FROM kl LEFT JOIN (SELECT {keys}, touched FROM kp WHERE k = n + m) t USING ({keys}))"""


@query(
    "data_drift_ks",
    "event_type feature n_reference:i n_current:i statistic:6 p_value:6 is_drifted:b action",
    "drift_reference drift_current",
    "WITH RECURSIVE " + _ks_sql("event_type").lstrip() + " SELECT *, p_value < 0.05 AS is_drifted, CASE WHEN p_value < 0.01 THEN "
    "'AUTO_RETRAIN' WHEN p_value < 0.05 THEN 'ALERT' ELSE 'OK' END AS action FROM ks",
)
def _(t: Tables):
    return D.data_drift_ks(t["drift_reference"], t["drift_current"], ["value", "uid"], ["event_type"])


def _psi_sql(joint: bool, by: str) -> str:
    keys = f"{by}, feature" if by else "feature"
    on = " AND ".join(f"lp.{k} = bo.{k}" for k in keys.replace(" ", "").split(","))
    spanned = "value" if joint else "CASE WHEN cur = 0 THEN value END"
    slack = "0" if joint else "1e-6"
    share_r = "r / CAST(ra AS DOUBLE) + 1e-6" if joint else "CASE WHEN r = 0 THEN 1e-6 ELSE r / (ri + 1e-6) END"
    share_c = "c / CAST(ca AS DOUBLE) + 1e-6" if joint else "CASE WHEN c = 0 THEN 1e-6 ELSE c / (ci + 1e-6) END"
    return f"""
lp AS ({_long_sql(by + "," if by else "")}),
bo AS (SELECT {keys}, min({spanned}) AS lo, max({spanned}) AS hi FROM lp GROUP BY {keys}),
pl AS (SELECT lp.*, CASE WHEN value >= lo - {slack} AND value <= hi + {slack} THEN
  {" + ".join(f"CASE WHEN value >= lo + (hi - lo) / 10 * {i} THEN 1 ELSE 0 END" for i in range(1, 10))} END AS bin
  FROM lp JOIN bo ON {on}),
tt AS (SELECT {keys}, count(*) FILTER (cur = 0) AS ra, count(*) FILTER (cur = 1) AS ca,
  count(*) FILTER (cur = 0 AND bin IS NOT NULL) AS ri, count(*) FILTER (cur = 1 AND bin IS NOT NULL) AS ci
  FROM pl GROUP BY {keys}),
bb AS (SELECT {keys}, i AS bin FROM tt, range(0, 10) q(i)),
bc AS (SELECT {keys}, bin, count(*) FILTER (cur = 0) AS r, count(*) FILTER (cur = 1) AS c FROM pl GROUP BY {keys}, bin),
sh AS (SELECT {keys}, ra, ca, {share_r} AS pr, {share_c} AS pc FROM (SELECT tt.*, bin, coalesce(r, 0) AS r,
  coalesce(c, 0) AS c FROM bb JOIN tt USING ({keys}) LEFT JOIN bc USING ({keys}, bin))),
ps AS (SELECT {keys}, max(ra) AS n_reference, max(ca) AS n_current, sum((pc - pr) * ln(pc / pr)) AS psi FROM sh
  GROUP BY {keys})"""


@query(
    "prediction_drift_psi",
    "event_type feature n_reference:i n_current:i psi:6 is_drifted:b action",
    "drift_reference drift_current",
    "WITH " + _psi_sql(False, "event_type").lstrip() + " SELECT *, psi >= 0.1 AS is_drifted, CASE WHEN psi >= 0.2 THEN "
    "'AUTO_RETRAIN' WHEN psi >= 0.1 THEN 'ALERT' ELSE 'OK' END AS action FROM ps WHERE feature = 'value'",
)
def _(t: Tables):
    return D.prediction_drift_psi(t["drift_reference"], t["drift_current"], "value", ["event_type"])


@query(
    "serving_drift",
    "feature ks_statistic:6 ks_pvalue:6 ks_drift:b psi:6 psi_drift:b drift_detected:b",
    "drift_reference drift_current",
    "WITH RECURSIVE " + _ks_sql("").lstrip() + "," + _psi_sql(True, "") + " SELECT feature, statistic AS ks_statistic, "
    "p_value AS ks_pvalue, p_value < 0.05 AS ks_drift, psi, psi > 0.20 AS psi_drift, p_value < 0.05 OR psi > 0.20 "
    "AS drift_detected FROM ks JOIN ps USING (feature)",
)
def _(t: Tables):
    return D.serving_drift(t["drift_reference"], t["drift_current"], ["value", "uid"])


# Models' forecasts leave the data's level by the day, so the defaults give every verdict.
THRESHOLD, DAYS = D.MAPE_THRESHOLD, D.CONSECUTIVE_DAYS

_CONCEPT_SQL = f"""
ok AS (SELECT model_id, max(ds) FILTER (mape <= {THRESHOLD}) AS o, count(*) AS history_length FROM model_mape GROUP BY 1),
rn AS (SELECT m.model_id, count(*) AS run FROM model_mape m JOIN ok ON m.model_id = ok.model_id
  WHERE o IS NULL OR ds > o GROUP BY 1),
rc AS (SELECT model_id, avg(mape) AS statistic FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ds DESC)
  AS i FROM model_mape) WHERE i <= {DAYS} GROUP BY 1),
cd AS (SELECT ok.model_id, statistic, coalesce(run, 0) AS consecutive_count, history_length,
  coalesce(run, 0) >= {DAYS} AS is_drifted, CASE WHEN coalesce(run, 0) >= {DAYS} THEN 'AUTO_RETRAIN'
  WHEN coalesce(run, 0) > 0 THEN 'ALERT' ELSE 'OK' END AS action
  FROM ok JOIN rc ON ok.model_id = rc.model_id LEFT JOIN rn ON rn.model_id = ok.model_id)"""


def _concept(t: Tables):
    return D.concept_drift(t["model_mape"], threshold=THRESHOLD, consecutive_days=DAYS)


@query(
    "concept_drift",
    "model_id statistic:6 consecutive_count:i history_length:i is_drifted:b action",
    "model_mape",
    "WITH " + _CONCEPT_SQL.lstrip() + " SELECT * FROM cd",
)
def _(t: Tables):
    return _concept(t)


@query(
    "retrain_verdict",
    "model_id should_retrain:b reason consecutive_count:i concept_drift_statistic:6 data_drift_triggered:b features",
    "model_mape drift_reference drift_current",
    "WITH RECURSIVE " + _CONCEPT_SQL.lstrip() + "," + _ks_sql("event_type") + """,
sv AS (SELECT event_type AS model_id, string_agg(feature, ',' ORDER BY feature) AS features FROM ks WHERE p_value < 0.01
  GROUP BY 1),
j AS (SELECT cd.*, coalesce(features, '') AS features, action = 'AUTO_RETRAIN' AS bc, features IS NOT NULL AS bd
  FROM cd LEFT JOIN sv ON cd.model_id = sv.model_id)
SELECT *, bc OR bd AS should_retrain, CASE WHEN bc AND bd THEN 'CONCEPT_AND_DATA_DRIFT' WHEN bc THEN 'CONCEPT_DRIFT_MAPE'
  WHEN bd THEN 'DATA_DRIFT_AUTO_RETRAIN' ELSE 'OK' END AS reason, statistic AS concept_drift_statistic,
  bd AS data_drift_triggered FROM j""",
)
def _(t: Tables):
    drift = D.data_drift_ks(t["drift_reference"], t["drift_current"], ["value", "uid"], ["event_type"])
    verdict = D.retrain_verdict(_concept(t), drift.withColumnRenamed("event_type", "model_id"))
    return verdict.withColumn("features", F.concat_ws(",", "triggering_features"))


@query(
    "retrain_history",
    "model_id ds:d current_mape:6 consecutive_count:i should_retrain:b reason",
    "model_mape",
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ds) AS rn FROM model_mape),
b AS (SELECT *, max(CASE WHEN NOT mape > {THRESHOLD} THEN rn WHEN day(ds) = 15 THEN rn - 1 END)
  OVER (PARTITION BY model_id ORDER BY ds) AS br FROM h),
c AS (SELECT *, rn - coalesce(br, 0) AS consecutive_count FROM b)
SELECT *, mape AS current_mape, consecutive_count >= {DAYS} AS should_retrain,
  CASE WHEN consecutive_count >= {DAYS} THEN 'CONCEPT_DRIFT_MAPE' ELSE 'OK' END AS reason FROM c""",
)
def _(t: Tables):
    history = t["model_mape"].withColumn("reset", F.dayofmonth("ds") == 15)
    return D.retrain_history(history, threshold=THRESHOLD, consecutive_days=DAYS, reset_before="reset")


_HALVES = """SELECT model_id, avg(CASE WHEN ds < DATE '2024-01-16' THEN mape END) AS base,
  avg(CASE WHEN ds >= DATE '2024-01-16' THEN mape END) AS cur FROM model_mape GROUP BY model_id"""


def _relative(t: Tables):
    t["model_mape"].createOrReplaceTempView("model_mape")
    halves = t.spark.sql(_HALVES)
    baseline = halves.select("model_id", F.col("base").alias("mape"))
    return D.relative_mape_drift(halves.select("model_id", F.col("cur").alias("mape")), baseline, threshold=0.05)


_RELATIVE_SQL = f"""
hv AS ({_HALVES}),
rl AS (SELECT model_id, base AS baseline, cur AS current, (cur - base) / base AS relative_change,
  (cur - base) / base > 0.05 AS drifted FROM hv)"""


@query(
    "relative_mape_drift",
    "model_id baseline:6 current:6 relative_change:5 drifted:b",
    "model_mape",
    "WITH " + _RELATIVE_SQL.lstrip() + " SELECT * FROM rl",
)
def _(t: Tables):
    return _relative(t)


@query(
    "monitoring_verdict",
    "model_id needs_retrain:b reasons next_step",
    "model_mape drift_reference drift_current",
    "WITH RECURSIVE " + _RELATIVE_SQL.lstrip() + "," + _ks_sql("event_type") + "," + _psi_sql(False, "event_type") + """,
kf AS (SELECT event_type, bool_or(p_value < 0.05) AS kd FROM ks GROUP BY 1),
j AS (SELECT model_id, drifted, coalesce(kd, false) AS kd, coalesce(psi >= 0.1, false) AS pd FROM rl
  LEFT JOIN kf ON kf.event_type = model_id LEFT JOIN ps ON ps.event_type = model_id AND ps.feature = 'value')
SELECT model_id, drifted OR kd OR pd AS needs_retrain, concat_ws(', ', CASE WHEN drifted THEN 'MAPE drift' END,
  CASE WHEN kd THEN 'feature drift' END, CASE WHEN pd THEN 'prediction drift' END) AS reasons,
  CASE WHEN drifted OR kd OR pd THEN 'trigger_retrain' ELSE 'no_action' END AS next_step FROM j""",
)
def _(t: Tables):
    ks = D.data_drift_ks(t["drift_reference"], t["drift_current"], ["value", "uid"], ["event_type"])
    feature = ks.groupBy(F.col("event_type").alias("model_id")).agg(F.bool_or("is_drifted").alias("feature"))
    psi = D.prediction_drift_psi(t["drift_reference"], t["drift_current"], "value", ["event_type"])
    prediction = psi.select(F.col("event_type").alias("model_id"), F.col("is_drifted").alias("prediction"))
    checks = _relative(t).join(feature, "model_id", "left").join(prediction, "model_id", "left")
    return D.monitoring_verdict(checks, "drifted", "feature", "prediction")


# Error metrics of two predictors per brand: the given one and a flat 25.
_METRICS = """SELECT group_label AS model_id, 'champion' AS role, avg(abs(y_true - y_pred) / greatest(abs(y_true), 1)) AS mape,
  sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, corr(y_true, y_pred) AS auuc FROM predictions GROUP BY group_label
UNION ALL SELECT group_label, 'challenger', avg(abs(y_true - 25) / greatest(abs(y_true), 1)),
  sqrt(avg((y_true - 25) * (y_true - 25))), 0.0 FROM predictions GROUP BY group_label"""


def _metrics(t: Tables):
    t["predictions"].createOrReplaceTempView("predictions")
    return t.spark.sql(_METRICS).unpivot(["model_id", "role"], ["mape", "rmse", "auuc"], "metric", "value")


_METRICS_SQL = f"""
me AS ({_METRICS}),
lg AS (SELECT model_id, role, 'mape' AS metric, mape AS value FROM me UNION ALL SELECT model_id, role, 'rmse', rmse FROM me
  UNION ALL SELECT model_id, role, 'auuc', auuc FROM me),
pr AS (SELECT a.model_id, CASE WHEN a.metric = 'auuc' THEN a.value > b.value ELSE a.value < b.value END AS win
  FROM lg a JOIN lg b ON a.model_id = b.model_id AND a.metric = b.metric AND a.role = 'challenger' AND b.role = 'champion')"""


@query(
    "champion_challenger",
    "model_id shared_metrics:i verdict",
    "predictions",
    "WITH " + _METRICS_SQL.lstrip() + " SELECT model_id, count(*) AS shared_metrics, CASE WHEN bool_and(win) THEN 'promoted' "
    "ELSE 'retained' END AS verdict FROM pr GROUP BY 1",
)
def _(t: Tables):
    return D.champion_challenger(_metrics(t))


@query(
    "model_comparison",
    "model_id wins:i losses:i verdict",
    "predictions",
    "WITH " + _METRICS_SQL.lstrip() + ", c AS (SELECT model_id, count(*) FILTER (win) AS wins, count(*) FILTER (NOT win) AS "
    "losses FROM pr GROUP BY 1) SELECT *, CASE WHEN wins > 0 AND losses = 0 THEN 'promote' WHEN losses > 0 AND wins = 0 "
    "THEN 'retain' ELSE 'mixed' END AS verdict FROM c",
)
def _(t: Tables):
    return D.model_comparison(_metrics(t))


@query(
    "series_forecast",
    "unique_id:i step:i ds:d model_used routing_reason point_forecast:3 lower_90:3 upper_90:3",
    "series",
    """WITH n AS (SELECT unique_id, count(y) AS n, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS z, max(ds) AS l
  FROM series GROUP BY 1),
t AS (SELECT unique_id, avg(y) AS base, coalesce(regr_slope(y, -i), 0) AS trend, stddev_pop(y) AS sp FROM (SELECT *,
  row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS i FROM series) WHERE i <= 30 GROUP BY 1),
s AS (SELECT n.*, base, trend, sp, step, greatest(0, base + trend * step) AS p FROM n JOIN t ON n.unique_id = t.unique_id,
  range(1, 15) q(step))
SELECT unique_id, step, l + CAST(step AS INT) AS ds,
  CASE WHEN n < 60 THEN 'chronos_zs' WHEN z > 0.30 THEN 'sarimax' ELSE 'lightgbm' END AS model_used,
  CASE WHEN n < 60 THEN 'Cold start: only ' || n || ' days of history (<60)'
    WHEN z > 0.30 THEN 'Intermittent demand: ' || CAST(round(z * 100) AS INT) || '% zero days (>30%)'
    ELSE 'Mature SKU with sufficient non-zero history' END AS routing_reason,
  p AS point_forecast, greatest(0, p - 1.645 * sp) AS lower_90, p + 1.645 * sp AS upper_90 FROM s""",
)
def _(t: Tables):
    return D.series_forecast(t["series"], digits=None)


# ---------------------------------------------------------------- audit


@query(
    "audit_recent",
    "timestamp user_name:i action outcome duration_ms:4",
    "audit_log",
    "SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, * EXCLUDE (timestamp) FROM (SELECT * FROM audit_log "
    "WHERE action LIKE 'e%' AND outcome = 'failure' ORDER BY timestamp DESC, user_name DESC LIMIT 100)",
)
def _(t: Tables):
    recent = A.audit_recent(t["audit_log"], action="e", outcome="failure", tie_breaker="user_name")
    return recent.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query(
    "audit_stats",
    "metric name value:i",
    "audit_log",
    """SELECT 'total_entries' AS metric, NULL AS name, count(*) AS value FROM audit_log
UNION ALL SELECT 'unique_users', NULL, count(DISTINCT user_name) FROM audit_log
UNION ALL SELECT 'outcome', outcome, count(*) FROM audit_log GROUP BY outcome
UNION ALL (SELECT 'top_action', action, count(*) FROM audit_log GROUP BY action ORDER BY count(*) DESC, action LIMIT 10)""",
)
def _(t: Tables):
    return A.audit_stats(t["audit_log"])


_REQUEST_LOG = """SELECT event_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'signup' THEN 'PUT'
  WHEN 'purchase' THEN 'DELETE' ELSE 'OPTIONS' END AS method,
  CASE user_id % 7 WHEN 0 THEN '/api/forecasts/SKU_' WHEN 1 THEN '/api/pipelines/run/' WHEN 2 THEN '/api/drift/status/'
    WHEN 3 THEN 'experiments/' WHEN 4 THEN '/api/costs//' WHEN 5 THEN '/api/' ELSE '/pipelines' END
  || CASE WHEN user_id % 7 < 5 THEN CAST(event_id AS VARCHAR(20)) ELSE '' END AS path FROM events"""


@query(
    "derive_audit_action",
    "event_id:i method path action",
    sql=f"""WITH q AS ({_REQUEST_LOG}),
s AS (SELECT *, list_filter(string_split(trim(path, '/'), '/'), lambda x: x <> '' AND x <> 'api') AS seg FROM q),
v AS (SELECT *, CASE method WHEN 'GET' THEN 'read' WHEN 'POST' THEN 'create' WHEN 'PUT' THEN 'update' WHEN 'PATCH' THEN
  'update' WHEN 'DELETE' THEN 'delete' ELSE lower(method) END AS verb FROM s)
SELECT event_id, method, path, CASE WHEN len(seg) = 0 THEN 'api.' || lower(method)
  WHEN seg[1] = 'pipelines' AND len(seg) > 1 THEN 'pipeline.' || seg[2] WHEN seg[1] = 'forecasts' THEN 'forecast.' || verb
  WHEN seg[1] = 'drift' THEN 'drift.' || verb WHEN seg[1] = 'experiments' THEN 'experiment.' || verb
  ELSE seg[1] || '.' || verb END AS action FROM v""",
)
def _(t: Tables):
    requests = t.sql(_REQUEST_LOG)
    return requests.withColumn("action", A.derive_audit_action(F.col("method"), F.col("path")))
