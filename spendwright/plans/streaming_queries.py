"""Queries of the streaming operators, each run over all its input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spendwright.operators import experiment as E
from spendwright.operators import features as X
from spendwright.plans import experiment_queries as EQ
from spendwright.plans import monitoring_queries as MQ
from spendwright.plans.registry import query
from spendwright.sources.session import materialise, new_path
from spendwright.sources.views import Tables
from spendwright.streaming import incremental as S

# Three consecutive spans that together cover every day.
_CUTS = (dt.date(2024, 1, 11), dt.date(2024, 1, 21))


def _in_three_parts(df, key: str, label: str) -> tuple[str, int]:
    """Write a dated table in three parts in time order, a key's rows of a part in one file.

    Rows without a day are in the last part. The second result is the number of
    files of the largest part: a stream that takes as many at a time has at
    most three micro-batches, however large the table.
    """
    path = new_path(df.sparkSession, label)
    rows = materialise(df, f"{label}-rows")  # computed once for the three parts
    ds = F.col("ds")
    part = F.when(ds < _CUTS[0], 0).when(ds < _CUTS[1], 1).otherwise(2)
    files = 1
    for i in range(3):
        rows.where(part == i).repartition(key).write.parquet(f"{path}/part={i}")
        files = max(files, len(df.sparkSession.read.schema(rows.schema).parquet(f"{path}/part={i}").inputFiles()))
    return path, files


@query(
    "stream_msprt",
    "experiment_id n_control:i n_treatment:i mean_control:4 mean_treatment:4 observed_delta:4 lambda_ratio:6 p_value:6 "
    "should_stop:b",
    sql="WITH u AS (" + EQ._OBSERVATIONS + "),\nub AS (SELECT *, "
    + EQ.bucket_sql(f"'{EQ.SALT}' || unit_id", 1000) + f" AS bucket FROM u),\na AS (SELECT *, {EQ.GROUP_CASE} AS grp FROM ub),"
    + """
mo AS (SELECT experiment_id,
  count(*) FILTER (grp = 'control') AS n_control, avg(value) FILTER (grp = 'control') AS mean_control,
  var_samp(value) FILTER (grp = 'control') AS var_control, count(*) FILTER (grp = 'treatment') AS n_treatment,
  avg(value) FILTER (grp = 'treatment') AS mean_treatment, var_samp(value) FILTER (grp = 'treatment') AS var_treatment
  FROM a GROUP BY 1),""" + EQ._msprt_sql("mo") + " SELECT * FROM msprt",
)
def _(t: Tables):
    events = S.parquet_stream(t.spark, S.table_glob(t.folder, "events.parquet"), t["events"].schema)
    rows = events.select(
        "event_id",
        F.col("event_type").alias("experiment_id"),
        F.col("user_id").cast("string").alias("unit_id"),
        "value",
    )
    rows = E.assign_batch(rows, "unit_id", EQ.SPLITS, EQ.SALT)
    tested = S.stream_msprt(rows, "value", "group", "control", "treatment", ["experiment_id"], "event_id", tau_sq=EQ.TAU_SQ)
    return S.latest_batch(S.drain(tested, "update", "msprt"), ["experiment_id"])


@query(
    "stream_concept_drift",
    "model_id statistic:6 consecutive_count:i history_length:i is_drifted:b action",
    "model_mape",
    "WITH " + MQ._CONCEPT_SQL.lstrip() + " SELECT * FROM cd",
)
def _(t: Tables):
    history = t["model_mape"]
    path, files = _in_three_parts(history, "model_id", "checks")
    checks = S.parquet_stream(t.spark, f"{path}/*", history.schema, files_per_batch=files)
    return S.stream_concept_drift(checks, threshold=MQ.THRESHOLD, consecutive_days=MQ.DAYS)


@query(
    "stream_latest_snapshot",
    f"unique_id:i ds:d y:4 {MQ._LAG_COLUMNS}",
    "series",
    "WITH f AS (" + MQ._rolling_sql("series") + "), r AS (SELECT *, row_number() OVER (PARTITION BY unique_id "
    "ORDER BY ds DESC) AS i FROM f) SELECT * FROM r WHERE i = 1",
)
def _(t: Tables):
    features = X.lag_rolling_features(t["series"])
    path, files = _in_three_parts(features, "unique_id", "features")
    stream = S.parquet_stream(t.spark, f"{path}/*", features.schema, files_per_batch=files)
    return S.upsert(S.stream_latest_snapshot(stream), ["unique_id"], "snapshot")


@query(
    "stream_audit_stats",
    "outcome action entries:i",
    "audit_log",
    "SELECT outcome, action, count(*) AS entries FROM audit_log GROUP BY 1, 2",
)
def _(t: Tables):
    log = t["audit_log"].select(F.col("timestamp").cast("timestamp").alias("timestamp"), "user_name", "action", "outcome")
    path = new_path(t.spark, "audit")
    log.write.json(path)
    stats = S.stream_audit_stats(S.json_stream(t.spark, path, log.schema))
    return S.upsert(stats, ["outcome", "action"], "audit-stats")
