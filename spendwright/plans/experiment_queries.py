"""Queries of the experimentation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendwright.operators import experiment as E
from spendwright.operators import interleaving as I
from spendwright.plans import resampling_sql as R
from spendwright.plans.registry import query
from spendwright.sources.views import Tables

SALT = "exp_001"
LAYERS = {"click": "layer_click", "view": "layer_view"}
SPLITS = {"control": 0.5, "treatment": 0.3, "challenger": 0.2}
HOLDOUT_SPLITS = {"control": 0.45, "treatment": 0.45}


def bucket_sql(text: str, n: int) -> str:
    return (
        f"list_reduce([0::BIGINT] || list_transform([0,1,2,3,4,5,6,7], lambda i: "
        f"CAST('0x' || substr(sha256({text}), CAST(1 + 8*i AS BIGINT), 8) AS BIGINT)), "
        f"lambda a, x: (a * 4294967296 + x) % {n})"
    )


# Units of five experiments, one per event type, with metrics before and after
# the midpoint of the event log.
EXPERIMENT_UNITS = """SELECT event_type AS experiment_id, CAST(user_id AS VARCHAR(20)) AS unit_id,
  sum(CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN value ELSE 0 END) AS pre_metric,
  sum(CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN value ELSE 0 END) AS post_metric
  FROM events GROUP BY event_type, user_id"""

GROUP_CASE = """CASE WHEN bucket / 1000.0 < 0.5 THEN 'control' WHEN bucket / 1000.0 < 0.8 THEN 'treatment'
  ELSE 'challenger' END"""
ARMS_SQL = f"""
u AS ({EXPERIMENT_UNITS}),
ub AS (SELECT *, {bucket_sql(f"'{SALT}' || unit_id", 1000)} AS bucket FROM u),
a AS (SELECT *, {GROUP_CASE} AS grp FROM ub)"""


def _assigned(t: Tables):
    return E.assign_batch(t.sql(EXPERIMENT_UNITS), "unit_id", SPLITS, SALT)


@query(
    "assign_bucket",
    "unit_id bucket:i",
    "ab_units",
    f"SELECT unit_id, {bucket_sql(chr(39) + SALT + chr(39) + ' || unit_id', 1000)} AS bucket FROM ab_units",
)
def _(t: Tables):
    return E.assign_bucket(t["ab_units"], "unit_id", F.lit(SALT))


@query(
    "assign_group",
    "unit_id bucket:i group",
    "ab_units",
    f"""WITH b AS (SELECT unit_id, {bucket_sql(chr(39) + SALT + chr(39) + ' || unit_id', 1000)} AS bucket FROM ab_units)
SELECT *, CASE WHEN bucket / 1000.0 < 0.45 THEN 'control' WHEN bucket / 1000.0 < 0.9 THEN 'treatment' END AS "group"
FROM b""",
)
def _(t: Tables):
    return E.assign_group(E.assign_bucket(t["ab_units"], "unit_id", F.lit(SALT)), HOLDOUT_SPLITS)


@query(
    "assign_batch",
    "experiment_id unit_id bucket:i arm",
    sql="WITH " + ARMS_SQL.lstrip() + " SELECT *, grp AS arm FROM a",
)
def _(t: Tables):
    return _assigned(t).withColumnRenamed("group", "arm")


@query(
    "layer_salts",
    "experiment_id unit_id bucket:i",
    sql=f"WITH u AS ({EXPERIMENT_UNITS}), s AS (SELECT *, CASE experiment_id WHEN 'click' THEN 'layer_click' "
    f"WHEN 'view' THEN 'layer_view' ELSE '{SALT}' END AS salt FROM u) "
    f"SELECT *, {bucket_sql('salt || unit_id', 1000)} AS bucket FROM s",
)
def _(t: Tables):
    salt = E.resolve_salt(SALT, LAYERS, F.col("experiment_id"))
    return E.assign_bucket(t.sql(EXPERIMENT_UNITS), "unit_id", salt)


@query(
    "srm_check",
    "experiment_id n_control:i n_treatment:i n_challenger:i chi2_statistic:6 p_value:6 is_srm:b",
    sql="WITH " + ARMS_SQL.lstrip() + """,
c AS (SELECT experiment_id, count(*) FILTER (grp = 'control') AS n_control,
  count(*) FILTER (grp = 'treatment') AS n_treatment, count(*) FILTER (grp = 'challenger') AS n_challenger,
  CAST(count(*) AS DOUBLE) AS n FROM a GROUP BY 1),
x AS (SELECT *, (n_control - 0.5 * n) ** 2 / (0.5 * n) + (n_treatment - 0.3 * n) ** 2 / (0.3 * n)
  + (n_challenger - 0.2 * n) ** 2 / (0.2 * n) AS chi2_statistic FROM c)
SELECT *, exp(-chi2_statistic / 2) AS p_value, exp(-chi2_statistic / 2) < 0.01 AS is_srm FROM x""",
)
def _(t: Tables):
    return E.srm_check(_assigned(t), SPLITS, ["experiment_id"])


@query(
    "bucket_distribution",
    "experiment_id n_units:i min_count:i max_count:i max_deviation_pct:4 chi2_statistic:4 p_value:6",
    sql=f"""WITH u AS ({EXPERIMENT_UNITS}),
b AS (SELECT experiment_id, {bucket_sql(chr(39) + SALT + chr(39) + ' || unit_id', 7)} AS bucket FROM u),
k AS (SELECT DISTINCT experiment_id, t.i AS bucket FROM u, range(0, 7) t(i)),
c AS (SELECT k.experiment_id, k.bucket, count(b.bucket) AS c FROM k LEFT JOIN b
  ON b.experiment_id = k.experiment_id AND b.bucket = k.bucket GROUP BY 1, 2),
s AS (SELECT experiment_id, sum(c) AS n_units, min(c) AS min_count, max(c) AS max_count, sum(c) / 7.0::DOUBLE AS e
  FROM c GROUP BY 1),
x AS (SELECT s.experiment_id, any_value(n_units) AS n_units, any_value(min_count) AS min_count,
  any_value(max_count) AS max_count, max(abs(c - e)) / greatest(any_value(e), 1e-9) * 100 AS max_deviation_pct,
  sum((c - e) ** 2 / e) AS chi2_statistic FROM s JOIN c ON s.experiment_id = c.experiment_id GROUP BY 1)
SELECT *, exp(-chi2_statistic / 2) * (1 + chi2_statistic / 2 + (chi2_statistic / 2) ** 2 / 2) AS p_value FROM x""",
)
def _(t: Tables):
    units = E.assign_bucket(t.sql(EXPERIMENT_UNITS), "unit_id", F.lit(SALT), 7)
    return E.bucket_distribution(units, 7, ["experiment_id"])


# ---------------------------------------------------------------- CUPED

_FIT_SQL = f"""
u AS ({EXPERIMENT_UNITS}),
m AS (SELECT experiment_id, count(*) AS n, var_samp(pre_metric) AS vx, var_samp(post_metric) AS vy,
  covar_samp(post_metric, pre_metric) AS c, avg(pre_metric) AS mean_pre FROM u GROUP BY 1),
fit AS (SELECT experiment_id, n, CASE WHEN coalesce(vx, 0) < 1e-12 THEN 0 ELSE c / vx END AS theta,
  CASE WHEN coalesce(vx, 0) < 1e-12 OR sqrt(vy) <= 1e-12 THEN 0 ELSE c / (sqrt(vy) * sqrt(vx)) END AS rho, mean_pre
  FROM m)"""


@query(
    "cuped_fit",
    "experiment_id n:i theta:6 rho:6 mean_pre:4 remaining_variance:6",
    sql="WITH " + _FIT_SQL.lstrip() + " SELECT *, 1 - rho * rho AS remaining_variance FROM fit",
)
def _(t: Tables):
    return E.cuped_fit(t.sql(EXPERIMENT_UNITS), "pre_metric", "post_metric", ["experiment_id"])


_ADJUSTED_SQL = _FIT_SQL + """,
adj AS (SELECT u.*, theta, rho, post_metric - theta * (pre_metric - mean_pre) AS adjusted
  FROM u JOIN fit ON u.experiment_id = fit.experiment_id)"""


@query(
    "cuped_transform",
    "experiment_id unit_id post_metric:4 adjusted:4",
    sql="WITH " + _ADJUSTED_SQL.lstrip() + " SELECT * FROM adj",
)
def _(t: Tables):
    units = t.sql(EXPERIMENT_UNITS)
    fit = E.cuped_fit(units, "pre_metric", "post_metric", ["experiment_id"])
    return E.cuped_transform(units, fit, "pre_metric", "post_metric", ["experiment_id"])


@query(
    "cuped_variance_reduction",
    "experiment_id var_raw:2 var_adjusted:2 variance_reduction:6 remaining_variance:6 rho:6 theta:6",
    sql="WITH " + _ADJUSTED_SQL.lstrip() + """,
s AS (SELECT experiment_id, var_samp(post_metric) AS var_raw, var_samp(adjusted) AS var_adjusted, max(rho) AS rho,
  max(theta) AS theta FROM adj GROUP BY 1)
SELECT *, CASE WHEN var_raw > 1e-12 THEN 1 - var_adjusted / var_raw ELSE 0 END AS variance_reduction,
  1 - rho * rho AS remaining_variance FROM s""",
)
def _(t: Tables):
    return E.cuped_variance_reduction(t.sql(EXPERIMENT_UNITS), "pre_metric", "post_metric", ["experiment_id"])


_BOOT_SXX, _BOOT_SXY, _BOOT_SYY = "xx - x * x / one", "xy - x * y / one", "yy - y * y / one"


@query(
    "cuped_bootstrap_ci",
    "experiment_id ci_lower:6 ci_upper:6 median:6 std:6",
    sql=f"""WITH u AS ({EXPERIMENT_UNITS}),
c AS (SELECT *, pre_metric - avg(pre_metric) OVER (PARTITION BY experiment_id) AS x,
  post_metric - avg(post_metric) OVER (PARTITION BY experiment_id) AS y FROM u),
r AS (SELECT *, x * x AS xx, x * y AS xy, y * y AS yy FROM c),{R.sums("r", ["unit_id"], ["x", "y", "xx", "xy", "yy"], ["experiment_id"], 1000)},
s AS (SELECT experiment_id, CASE WHEN one > 1 AND ({_BOOT_SXX}) / (one - 1) >= 1e-12 AND ({_BOOT_SYY}) / (one - 1) > 1e-12
  THEN ({_BOOT_SXY}) ** 2 / (({_BOOT_SXX}) * ({_BOOT_SYY})) ELSE 0 END AS v FROM boot)
SELECT experiment_id, quantile_cont(v, 0.025) AS ci_lower, quantile_cont(v, 0.975) AS ci_upper, quantile_cont(v, 0.5) AS median,
  stddev_samp(v) AS std FROM s GROUP BY 1""",
)
def _(t: Tables):
    return E.cuped_bootstrap_ci(
        t.sql(EXPERIMENT_UNITS), "pre_metric", "post_metric", ["unit_id"], ["experiment_id"]
    )


# ---------------------------------------------------------------- sequential

TAU_SQ = 25.0


def _msprt_sql(source: str) -> str:
    """mSPRT columns over a relation with the per-arm moments."""
    return f"""
q1 AS (SELECT *, greatest(CASE WHEN n_control > 1 AND n_treatment > 1 THEN ((n_control - 1) * var_control
    + (n_treatment - 1) * var_treatment) / (n_control + n_treatment - 2) WHEN n_control > 1 THEN var_control
    WHEN n_treatment > 1 THEN var_treatment ELSE 1.0 END, 1e-12) AS v,
  CAST(least(n_control, n_treatment) AS DOUBLE) AS tt,
  CASE WHEN n_control > 0 AND n_treatment > 0 THEN mean_treatment - mean_control ELSE 0 END AS observed_delta
  FROM {source}),
q2 AS (SELECT *, CASE WHEN n_control >= 2 AND n_treatment >= 2 THEN exp(least(greatest(0.5 * (ln(v) - ln(v + tt * {TAU_SQ}))
    + tt * tt * {TAU_SQ} * observed_delta * observed_delta / (2.0 * v * (v + tt * {TAU_SQ})), -500), 500)) ELSE 0 END
    AS lambda_ratio,
  CASE WHEN n_control >= 2 AND n_treatment >= 2 THEN
    sqrt((v / tt) * (v + tt * {TAU_SQ}) / (v * {TAU_SQ}) * 2.0 * ln(1.0 / 0.05)) END AS half FROM q1),
msprt AS (SELECT *, CASE WHEN lambda_ratio > 0 THEN least(1.0, 1.0 / lambda_ratio) ELSE 1.0 END AS p_value,
  observed_delta - half AS cs_lower, observed_delta + half AS cs_upper, lambda_ratio >= 1.0 / 0.05 AS should_stop
  FROM q2)"""


_MOMENTS_SQL = ARMS_SQL + """,
mo AS (SELECT experiment_id,
  count(*) FILTER (grp = 'control') AS n_control, avg(post_metric) FILTER (grp = 'control') AS mean_control,
  var_samp(post_metric) FILTER (grp = 'control') AS var_control,
  count(*) FILTER (grp = 'treatment') AS n_treatment, avg(post_metric) FILTER (grp = 'treatment') AS mean_treatment,
  var_samp(post_metric) FILTER (grp = 'treatment') AS var_treatment FROM a GROUP BY 1)"""
_MSPRT_COLUMNS = (
    "experiment_id n_control:i n_treatment:i mean_control:4 mean_treatment:4 observed_delta:4 lambda_ratio:6 p_value:6 "
    "should_stop:b"
)


def _moments(t: Tables):
    return E.arm_moments(_assigned(t), "post_metric", "group", "control", "treatment", ["experiment_id"])


@query("msprt", _MSPRT_COLUMNS, sql="WITH " + _MOMENTS_SQL.lstrip() + "," + _msprt_sql("mo") + " SELECT * FROM msprt")
def _(t: Tables):
    return E.msprt(_moments(t), TAU_SQ)


@query(
    "msprt_confidence_sequence",
    "experiment_id observed_delta:4 cs_lower:4 cs_upper:4",
    sql="WITH " + _MOMENTS_SQL.lstrip() + "," + _msprt_sql("mo") + " SELECT * FROM msprt",
)
def _(t: Tables):
    return E.msprt(_moments(t), TAU_SQ)


_OBSERVATIONS = """SELECT event_type AS experiment_id, CAST(user_id AS VARCHAR(20)) AS unit_id,
  CAST(ts AS DATE) AS day, value FROM events"""


@query(
    "msprt_peeking_curve",
    "experiment_id day:d n_control:i n_treatment:i observed_delta:4 lambda_ratio:5 p_value:5 cs_lower:3 cs_upper:3 "
    "should_stop:b",
    sql=f"""WITH o AS ({_OBSERVATIONS}),
ob AS (SELECT *, {bucket_sql(chr(39) + SALT + chr(39) + ' || unit_id', 1000)} AS bucket FROM o),
oa AS (SELECT *, {GROUP_CASE} AS grp FROM ob),
dd AS (SELECT experiment_id, day, count(*) FILTER (grp = 'control') AS nc, count(*) FILTER (grp = 'treatment') AS nt,
  coalesce(sum(value) FILTER (grp = 'control'), 0) AS sc, coalesce(sum(value) FILTER (grp = 'treatment'), 0) AS st,
  coalesce(sum(value * value) FILTER (grp = 'control'), 0) AS qc,
  coalesce(sum(value * value) FILTER (grp = 'treatment'), 0) AS qt FROM oa GROUP BY 1, 2),
cu AS (SELECT experiment_id, day, """
    + ", ".join(
        f"sum({c}) OVER (PARTITION BY experiment_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS {c}"
        for c in ("nc", "nt", "sc", "st", "qc", "qt")
    )
    + """ FROM dd),
mo AS (SELECT experiment_id, day, CAST(nc AS BIGINT) AS n_control, CAST(nt AS BIGINT) AS n_treatment,
  CASE WHEN nc > 0 THEN sc / nc END AS mean_control, CASE WHEN nt > 0 THEN st / nt END AS mean_treatment,
  CASE WHEN nc > 1 THEN greatest(qc - sc * sc / nc, 0) / (nc - 1) END AS var_control,
  CASE WHEN nt > 1 THEN greatest(qt - st * st / nt, 0) / (nt - 1) END AS var_treatment FROM cu),"""
    + _msprt_sql("mo")
    + " SELECT * FROM msprt",
)
def _(t: Tables):
    rows = E.assign_batch(t.sql(_OBSERVATIONS), "unit_id", SPLITS, SALT)
    return E.msprt_peeking_curve(
        rows, "value", "group", "control", "treatment", "day", ["experiment_id"], TAU_SQ
    )


# ---------------------------------------------------------------- interleaving


# Two rankings per session; the second leaves out documents seen a multiple of
# three times, so lists differ in length. Odd sessions let ranking A start.
_LISTS = """SELECT session_id, doc, clicked, score_a, CASE WHEN score_a % 3 <> 0 THEN score_b END AS score_b FROM sessions"""
K = 4


def _draft_step(i: int) -> str:
    turn = "coin = 1" if i % 2 == 0 else "coin = 0"
    pick = f"list_filter(CASE WHEN {turn} THEN a ELSE b END, lambda x: NOT list_contains(placed, x))[1]"
    return f"""
p{i} AS (SELECT *, {pick} AS pick FROM s{i}),
s{i + 1} AS (SELECT session_id, a, b, coin, live AND pick IS NOT NULL AS live,
  CASE WHEN live AND pick IS NOT NULL THEN list_append(placed, pick) ELSE placed END AS placed,
  CASE WHEN live AND pick IS NOT NULL AND {turn} THEN list_append(own_a, pick) ELSE own_a END AS own_a FROM p{i})"""


_DRAFT_SQL = f"""
li AS ({_LISTS}),
s0 AS (SELECT session_id, coalesce(list(doc ORDER BY score_a DESC, doc), []) AS a,
  coalesce(list(doc ORDER BY score_b DESC, doc) FILTER (score_b IS NOT NULL), []) AS b, session_id % 2 AS coin, true AS live,
  CAST([] AS VARCHAR[]) AS placed, CAST([] AS VARCHAR[]) AS own_a FROM li GROUP BY 1),""" + ",".join(
    _draft_step(i) for i in range(K)
) + f""",
dr AS (SELECT session_id, placed AS interleaved,
  list_filter(placed, lambda x: list_contains(own_a, x) OR (list_contains(a, x) AND list_contains(b, x))) AS team_a,
  list_filter(placed, lambda x: NOT list_contains(own_a, x) OR (list_contains(a, x) AND list_contains(b, x))) AS team_b
  FROM s{K})"""


def _drafted(t: Tables):
    t["sessions"].createOrReplaceTempView("sessions")
    ranked = I.ranked_lists(t.spark.sql(_LISTS), "session_id", "doc", "score_a", "score_b", k=K)
    return I.team_draft(ranked.withColumn("coin", F.col("session_id") % 2), "session_id", k=K, coin="coin")


@query(
    "team_draft",
    "session_id:i interleaved team_a team_b",
    "sessions",
    "WITH " + _DRAFT_SQL.lstrip() + " SELECT session_id, array_to_string(interleaved, ',') AS interleaved, "
    "array_to_string(team_a, ',') AS team_a, array_to_string(team_b, ',') AS team_b FROM dr",
)
def _(t: Tables):
    texts = [F.concat_ws(",", c).alias(c) for c in ("interleaved", "team_a", "team_b")]
    return _drafted(t).select("session_id", *texts)


# Documents shown to a session: the first three of each ranking.
_SHOWN = """SELECT session_id, doc, clicked, ra <= 3 AS in_a, rb <= 3 AS in_b FROM (SELECT *,
  row_number() OVER (PARTITION BY session_id ORDER BY score_a DESC, doc) AS ra,
  row_number() OVER (PARTITION BY session_id ORDER BY score_b DESC, doc) AS rb FROM sessions) r
  WHERE ra <= 3 OR rb <= 3"""
_DELTA_SQL = f"""
sh AS ({_SHOWN}),
cr AS (SELECT session_id, sum(CASE WHEN clicked = 1 AND in_a AND in_b THEN 1 WHEN clicked = 1 AND in_a THEN 2 ELSE 0 END)
  AS clicks_a, sum(CASE WHEN clicked = 1 AND in_a AND in_b THEN 1 WHEN clicked = 1 AND in_b THEN 2 ELSE 0 END) AS clicks_b
  FROM sh GROUP BY 1),
de AS (SELECT *, (clicks_b / 2.0::DOUBLE - clicks_a / 2.0::DOUBLE)
  / (clicks_a / 2.0::DOUBLE + clicks_b / 2.0::DOUBLE + 1e-9) AS delta FROM cr)"""


def _deltas(t: Tables):
    t["sessions"].createOrReplaceTempView("sessions")
    shown = t.sql(_SHOWN)
    clicks = t["sessions"].where("clicked = 1").select("session_id", "doc")
    return I.interleaving_delta(shown, clicks, "session_id")


@query(
    "interleaving_delta",
    "session_id:i clicks_a:i clicks_b:i delta:6",
    "sessions",
    "WITH " + _DELTA_SQL.lstrip() + " SELECT * FROM de",
)
def _(t: Tables):
    return _deltas(t)


@query(
    "interleaving_experiment",
    "n_trials:i mean_delta:6 std_delta:6 t_statistic:5 p_value:5 winner total_clicks_a:i total_clicks_b:i",
    "sessions",
    "WITH " + _DELTA_SQL.lstrip() + """,
s AS (SELECT count(*) AS n_trials, avg(delta) AS mean_delta, stddev_samp(delta) AS std_delta,
  sum(clicks_a) AS total_clicks_a, sum(clicks_b) AS total_clicks_b FROM de),
x AS (SELECT *, mean_delta / (std_delta / sqrt(n_trials)) AS t_statistic, n_trials - 1 AS nu FROM s),
y AS (SELECT *, abs(t_statistic) AS t, nu / (nu + t_statistic * t_statistic) AS c2 FROM x),
z AS (SELECT *, CASE WHEN nu % 2 = 1 THEN
    1 - 2 / pi() * (atan(t / sqrt(nu)) + sqrt(1 - c2) * sqrt(c2) * list_sum(list_transform(
      range(0, CAST((nu - 1) // 2 AS BIGINT)), lambda k: list_aggregate([1.0::DOUBLE] || list_transform(
        range(1, k + 1), lambda j: 2.0::DOUBLE * j / (2 * j + 1) * c2), 'product'))))
  ELSE 1 - sqrt(1 - c2) * list_sum(list_transform(range(0, CAST(nu // 2 AS BIGINT)), lambda k: list_aggregate(
      [1.0::DOUBLE] || list_transform(range(1, k + 1), lambda j: (2.0::DOUBLE * j - 1) / (2 * j) * c2), 'product')))
  END AS p_value FROM y)
SELECT *, CASE WHEN p_value > 0.05 THEN 'tie' WHEN mean_delta > 0 THEN 'B' ELSE 'A' END AS winner FROM z""",
)
def _(t: Tables):
    return I.interleaving_experiment(_deltas(t))


@query(
    "interleaving_drafted_experiment",
    "n_trials:i mean_delta:6 std_delta:6 total_clicks_a:i total_clicks_b:i",
    "sessions",
    "WITH " + _DRAFT_SQL.lstrip() + """,
ex AS (SELECT session_id, unnest(interleaved) AS doc, team_a, team_b FROM dr),
cl AS (SELECT ex.session_id, coalesce(clicked, 0) = 1 AS hit, list_contains(team_a, ex.doc) AS ia,
  list_contains(team_b, ex.doc) AS ib FROM ex LEFT JOIN li ON li.session_id = ex.session_id AND li.doc = ex.doc),
cr AS (SELECT session_id, sum(CASE WHEN hit AND ia AND ib THEN 1 WHEN hit AND ia THEN 2 ELSE 0 END) AS clicks_a,
  sum(CASE WHEN hit AND ia AND ib THEN 1 WHEN hit AND ib THEN 2 ELSE 0 END) AS clicks_b FROM cl GROUP BY 1),
de AS (SELECT *, (clicks_b - clicks_a) / 2.0::DOUBLE / ((clicks_a + clicks_b) / 2.0::DOUBLE + 1e-9) AS delta FROM cr)
SELECT count(*) AS n_trials, avg(delta) AS mean_delta, stddev_samp(delta) AS std_delta, sum(clicks_a) AS total_clicks_a,
  sum(clicks_b) AS total_clicks_b FROM de""",
)
def _(t: Tables):
    """The whole chain on drafted lists: rank, draft, credit clicks, test."""
    shown = I.shown_documents(_drafted(t), "session_id")
    clicks = t["sessions"].where("clicked = 1").select("session_id", "doc")
    return I.interleaving_experiment(I.interleaving_delta(shown, clicks, "session_id"))


# ---------------------------------------------------------------- planning

_BASELINES = """SELECT event_type AS segment, avg(value) AS baseline_mean, stddev_samp(value) AS baseline_std,
  count(*) / CAST(count(DISTINCT CAST(ts AS DATE)) AS DOUBLE) AS daily_traffic FROM events GROUP BY event_type"""
# z(0.975) + z(0.8), squared and doubled
_Z_SQL = "2.0 * (CAST(1.9599639845400545 AS DOUBLE) + CAST(0.8416212335729143 AS DOUBLE)) ** 2"


def _size_sql(levels: str) -> str:
    return f"""WITH b AS ({_BASELINES}), l AS (SELECT unnest({levels}) AS m),
r AS (SELECT *, CAST(ceil({_Z_SQL} * baseline_std * baseline_std / ((m * baseline_mean) * (m * baseline_mean))) AS BIGINT)
  AS n_per_group_raw FROM b, l),
c AS (SELECT *, greatest(1, CAST(ceil(n_per_group_raw * (1.0 - CAST(0.74 AS DOUBLE) * 0.74)) AS BIGINT)) AS n_per_group_cuped FROM r)
SELECT *, m AS mde_relative, m * baseline_mean AS mde_absolute, 2 * n_per_group_raw AS n_total_raw,
  2 * n_per_group_cuped AS n_total_cuped, (1.0 - n_per_group_cuped / CAST(n_per_group_raw AS DOUBLE)) * 100
  AS cuped_reduction_pct, m * 100 AS mde_pct, ceil(2 * n_per_group_raw / daily_traffic) AS experiment_days_raw,
  ceil(2 * n_per_group_cuped / daily_traffic) AS experiment_days_cuped FROM c"""


@query(
    "required_sample_size",
    "segment mde_relative:4 mde_absolute:4 n_per_group_raw:i n_total_raw:i n_per_group_cuped:i n_total_cuped:i "
    "cuped_reduction_pct:4",
    sql=_size_sql("[CAST(0.05 AS DOUBLE)]"),
)
def _(t: Tables):
    return E.required_sample_size(t.sql(_BASELINES), 0.05, rho=0.74)


@query(
    "mde_table",
    "segment mde_pct:1 n_per_group_raw:i n_total_raw:i n_per_group_cuped:i n_total_cuped:i experiment_days_raw:i "
    "experiment_days_cuped:i",
    sql=_size_sql("[CAST(0.03 AS DOUBLE), CAST(0.05 AS DOUBLE), CAST(0.10 AS DOUBLE)]"),
)
def _(t: Tables):
    return E.mde_table(t.sql(_BASELINES), rho=0.74, daily_traffic="daily_traffic")


@query(
    "experiment_report",
    "experiment_id n_observations:i srm_chi2:6 srm_p_value:6 srm_passed:b rho:6 variance_reduction:6 "
    "effective_sample_size_multiplier:6 cuped_control_mean:4 cuped_treatment_mean:4 decision lambda_ratio:5 p_value:5 "
    "observed_delta:4 cs_lower:3 cs_upper:3 significant:b",
    sql="WITH " + ARMS_SQL.lstrip() + """,
g AS (SELECT experiment_id, count(*) AS n_observations, covar_samp(post_metric, pre_metric) / var_samp(pre_metric) AS theta,
  covar_samp(post_metric, pre_metric) / (sqrt(var_samp(pre_metric)) * sqrt(var_samp(post_metric))) AS rho,
  avg(pre_metric) AS mx, count(*) FILTER (grp = 'control') AS k0, count(*) FILTER (grp = 'treatment') AS k1,
  count(*) FILTER (grp = 'challenger') AS k2 FROM a GROUP BY 1),
ad AS (SELECT a.experiment_id, grp, post_metric - theta * (pre_metric - mx) AS z FROM a JOIN g
  ON a.experiment_id = g.experiment_id),
mo AS (SELECT experiment_id,
  count(*) FILTER (grp = 'control') AS n_control, avg(z) FILTER (grp = 'control') AS mean_control,
  var_samp(z) FILTER (grp = 'control') AS var_control, count(*) FILTER (grp = 'treatment') AS n_treatment,
  avg(z) FILTER (grp = 'treatment') AS mean_treatment, var_samp(z) FILTER (grp = 'treatment') AS var_treatment
  FROM ad GROUP BY 1),""" + _msprt_sql("mo") + """,
r AS (SELECT g.*, msprt.* EXCLUDE (experiment_id), n_observations >= 140 AS ready,
  (k0 - 0.5 * n_observations) ** 2 / (0.5 * n_observations) + (k1 - 0.3 * n_observations) ** 2 / (0.3 * n_observations)
  + (k2 - 0.2 * n_observations) ** 2 / (0.2 * n_observations) AS srm_chi2 FROM g JOIN msprt
  ON g.experiment_id = msprt.experiment_id)
SELECT experiment_id, n_observations, srm_chi2, exp(-srm_chi2 / 2) AS srm_p_value, exp(-srm_chi2 / 2) >= 0.01 AS srm_passed,
  rho, rho * rho AS variance_reduction, 1 / (1 - rho * rho) AS effective_sample_size_multiplier,
  mean_control AS cuped_control_mean, mean_treatment AS cuped_treatment_mean,
  CASE WHEN ready THEN 'sequential_test' ELSE 'collect_more' END AS decision,
  CASE WHEN ready THEN lambda_ratio END AS lambda_ratio, CASE WHEN ready THEN p_value END AS p_value,
  CASE WHEN ready THEN observed_delta END AS observed_delta, CASE WHEN ready THEN cs_lower END AS cs_lower,
  CASE WHEN ready THEN cs_upper END AS cs_upper, CASE WHEN ready THEN should_stop ELSE false END AS significant FROM r""",
)
def _(t: Tables):
    return E.experiment_report(
        _assigned(t), "pre_metric", "post_metric", SPLITS, "control", "treatment", ["experiment_id"],
        min_samples=140, tau_sq=TAU_SQ,
    )
