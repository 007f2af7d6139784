"""Queries of treatment effects, uplift models and explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendwright.functions.hashing import hash_order_sql, standard_normal_sql, unit_interval_sql
from spendwright.operators import boosting as B
from spendwright.operators import causal as C
from spendwright.operators import explain as X
from spendwright.operators import uplift as U
from spendwright.plans import resampling_sql as R
from spendwright.plans.registry import query
from spendwright.sources.session import materialise
from spendwright.sources.views import Tables

KEY = ["unit_id"]
CONFOUNDERS = ["x0", "x1", "x2"]
FEATURES = ["x0", "x1", "x2"]


@query(
    "ate_ols",
    "x1:0 n:i ate:4",
    "uplift_units",
    # One confounder per group: the two-regressor least-squares closed form.
    """WITH m AS (SELECT x1, count(*) AS n, covar_pop(treatment, outcome) AS cty, covar_pop(x0, outcome) AS cxy,
  covar_pop(treatment, x0) AS ctx, var_pop(x0) AS vx, var_pop(treatment) AS vt FROM uplift_units GROUP BY x1)
SELECT x1, n, (cty * vx - cxy * ctx) / (vt * vx - ctx * ctx) AS ate FROM m""",
)
def _(t: Tables):
    return C.ate_ols(t["uplift_units"], "treatment", "outcome", ["x0"], by=["x1"])


@query(
    "ate_ols_all_confounders",
    "n:i ate:4",
    "uplift_units",
    # Residualise one regressor after the other; the effect is the slope on
    # what remains of the treatment.
    """WITH a AS (SELECT *, x1 - regr_slope(x1, x0) OVER () * x0 AS r1 FROM uplift_units),
b AS (SELECT *, x2 - regr_slope(x2, x0) OVER () * x0 - regr_slope(x2, r1) OVER () * r1 AS r2 FROM a),
c AS (SELECT *, treatment - regr_slope(treatment, x0) OVER () * x0 - regr_slope(treatment, r1) OVER () * r1
  - regr_slope(treatment, r2) OVER () * r2 AS tr FROM b)
SELECT count(*) AS n, regr_slope(outcome, tr) AS ate FROM c""",
)
def _(t: Tables):
    return C.ate_ols(t["uplift_units"], "treatment", "outcome", CONFOUNDERS)


@query(
    "causal_columns_check",
    "n:i treated:i",
    "uplift_units",
    "SELECT count(*) AS n, sum(treatment) AS treated FROM uplift_units",
)
def _(t: Tables):
    checked = C.causal_columns_check(t["uplift_units"], "treatment", "outcome", CONFOUNDERS)
    return checked.agg(F.count(F.lit(1)).alias("n"), F.sum("treatment").alias("treated"))


_CENTRED = ["x0", "x1", "x2", "treatment", "outcome"]
_PRODUCTS, _SLOPE = R.slope(["c_" + n for n in _CENTRED])
_ATE_INTERVAL = (
    "c AS (SELECT unit_id, " + ", ".join(f"{n} - avg({n}) OVER () AS c_{n}" for n in _CENTRED) + " FROM uplift_units),\n"
    + "r AS (SELECT *, " + ", ".join(_PRODUCTS) + " FROM c),"
    + R.sums("r", KEY, [*["c_" + n for n in _CENTRED], *[p.split(" AS ")[1] for p in _PRODUCTS]], [], 500) + _SLOPE
)


@query(
    "ate_bootstrap_ci",
    "ci_lower:4 ci_upper:4",
    "uplift_units",
    f"WITH {_ATE_INTERVAL} SELECT quantile_cont(ate, 0.025) AS ci_lower, quantile_cont(ate, 0.975) AS ci_upper FROM solved",
)
def _(t: Tables):
    return C.ate_bootstrap_ci(t["uplift_units"], "treatment", "outcome", CONFOUNDERS, KEY)


def _refuted(t: Tables, method: str):
    return C.refute(t["uplift_units"], method, "treatment", "outcome", CONFOUNDERS, KEY)


# The three changed relations, by the same hashed draws.
_REFUTED_SQL = {
    "random_common_cause": (f"(SELECT *, {standard_normal_sql(KEY, 0)} AS cause FROM uplift_units)", [*CONFOUNDERS, "cause"]),
    "placebo_treatment": (
        f"(SELECT a.* EXCLUDE (treatment), b.treatment FROM (SELECT *, row_number() OVER (ORDER BY {hash_order_sql(KEY, 0)}, unit_id) AS k"
        f" FROM uplift_units) a JOIN (SELECT treatment, row_number() OVER (ORDER BY {hash_order_sql(KEY, 1)}, unit_id) AS k FROM uplift_units) b USING (k))",
        CONFOUNDERS,
    ),
    "data_subset": (f"(SELECT * FROM uplift_units WHERE {unit_interval_sql(KEY, 0)} < {C.SUBSET_SHARE})", CONFOUNDERS),
}
_REFUTED = {m: f"SELECT '{m}' AS method, {R.ols(source, names, 'treatment', 'outcome')} AS new_ate" for m, (source, names) in _REFUTED_SQL.items()}
_SHIFT = "abs(new_ate - CASE WHEN method = 'placebo_treatment' THEN 0 ELSE orig_ate END)"
_REPORT = f"""WITH {_ATE_INTERVAL},
ci AS (SELECT quantile_cont(ate, 0.025) AS ci_lower, quantile_cont(ate, 0.975) AS ci_upper FROM solved),
e AS (SELECT (SELECT count(*) FROM uplift_units) AS n, {R.ols("uplift_units", CONFOUNDERS, "treatment", "outcome")} AS orig_ate),
m AS ({" UNION ALL ".join(_REFUTED.values())}),
z AS (SELECT *, {_SHIFT} / ((ci_upper - ci_lower) / 2 / 1.96 + 1e-12) AS z FROM m, e, ci),
p AS (SELECT *, {R.two_sided("z")} AS pvalue FROM z)
SELECT *, pvalue > {C.PASS_LEVEL} AS passed FROM p"""


def _register_refuter(method: str) -> None:
    @query(f"refute_{method}", "method new_ate:4", "uplift_units", _REFUTED[method])
    def _(t: Tables):
        return C.refute(t["uplift_units"], method, "treatment", "outcome", CONFOUNDERS, KEY)


for _method in C.METHODS:
    _register_refuter(_method)


@query("refutation_pvalue", "method new_ate:4 orig_ate:4 pvalue:4 passed:b", "uplift_units", _REPORT)
def _(t: Tables):
    return C.causal_report(t["uplift_units"], "treatment", "outcome", CONFOUNDERS, KEY).select(
        "method", "new_ate", "orig_ate", "pvalue", "passed"
    )


@query("causal_report", "method n:i orig_ate:4 ci_lower:4 ci_upper:4 new_ate:4 pvalue:4 passed:b", "uplift_units", _REPORT)
def _(t: Tables):
    return C.causal_report(t["uplift_units"], "treatment", "outcome", CONFOUNDERS, KEY)


# ---------------------------------------------------------------- learners


# Models of this session by table folder: several queries score the same learners.
_MODELS: dict[tuple[str, str], U.UpliftModel] = {}
_SUPPLIER_MODELS: dict[tuple[str, str], tuple[DataFrame, B.CellModel]] = {}


def _model_key(t: Tables) -> tuple[str, str]:
    return t.spark.sparkContext.applicationId, t.folder


def _fitted(t: Tables, *learners: str):
    units = t["uplift_units"]
    model = _MODELS.setdefault(_model_key(t), U.UpliftModel(FEATURES))
    missing = [name for name in learners if not model.is_fitted(name)]
    if missing:
        model.fit(units, missing)
    return units, model


def _register_learner(name: str) -> None:
    @query(name, "unit_id:i cate:4")
    def _(t: Tables):
        units, model = _fitted(t, name)
        return model.predict_cate(units, name)


for _name in U.LEARNERS:
    _register_learner(_name)


@query("predict_cate", "learner n:i mean_cate:4 min_cate:4 max_cate:4")
def _(t: Tables):
    units, model = _fitted(t, *U.LEARNERS)
    rows = []
    for name in U.LEARNERS:
        scored = model.predict_cate(units, name).agg(
            F.count("cate").alias("n"), F.avg("cate").alias("mean_cate"),
            F.min("cate").alias("min_cate"), F.max("cate").alias("max_cate"),
        )
        rows.append(scored.withColumn("learner", F.lit(name)))
    return reduce(DataFrame.unionByName, rows)


@query("uplift_ablation", "learner auuc:4 ci_lower:4 ci_upper:4 ci_width:4 target_auuc:2 within_target:b")
def _(t: Tables):
    """Outcomes in thousands, so that the areas stay inside (0, 1)."""
    units, model = _fitted(t, *U.LEARNERS)
    return U.uplift_ablation(model, units.withColumn("outcome", F.col("outcome") / 1000.0), KEY)


# ---------------------------------------------------------------- evaluation

# A scored table: the effect the units were built with, coarse enough for ties.
_SCORED = "SELECT unit_id, treatment, outcome, round(x0 / 1000.0) AS cate FROM uplift_units"
_CURVE_SQL = f"""
s AS ({_SCORED}),
c AS (SELECT *, row_number() OVER w AS position, sum(treatment) OVER w AS nt, sum(1 - treatment) OVER w AS nc,
  sum(treatment * outcome) OVER w AS st, sum((1 - treatment) * outcome) OVER w AS sc, count(*) OVER () AS n
  FROM s WINDOW w AS (ORDER BY cate DESC, unit_id ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, position / CAST(n AS DOUBLE) AS fraction, st / greatest(nt, 1) - sc / greatest(nc, 1) AS uplift FROM c)"""


def _scored(t: Tables):
    units = t["uplift_units"]
    return units.select("unit_id", "treatment", "outcome", F.round(F.col("x0") / 1000.0).alias("cate"))


@query(
    "uplift_curve",
    "unit_id:i cate:4 position:i fraction:6 uplift:4",
    "uplift_units",
    "WITH " + _CURVE_SQL.lstrip() + " SELECT * FROM u",
)
def _(t: Tables):
    return U.uplift_curve(_scored(t), KEY)


@query(
    "auuc",
    "n_units:i auuc:6",
    "uplift_units",
    "WITH " + _CURVE_SQL.lstrip().replace("FROM uplift_units", "FROM (SELECT *, outcome / 1000.0 AS small FROM uplift_units)")
    .replace("outcome, round", "small AS outcome, round") + """,
a AS (SELECT count(*) AS n_units, (sum(uplift) - max(CASE WHEN position = n THEN uplift END) / 2) / count(*) AS raw,
  max(nt) AS t, max(nc) AS c FROM u)
SELECT n_units, CASE WHEN t = 0 OR c = 0 THEN 0.5 ELSE least(greatest(raw + 0.5, 0), 1) END AS auuc FROM a""",
)
def _(t: Tables):
    """Outcomes in thousands, so that the area stays inside (0, 1)."""
    return U.auuc(_scored(t).withColumn("outcome", F.col("outcome") / 1000.0), KEY)


# Every copy of a unit is a step of the replicate's curve.
_AREA_INTERVAL = f"""WITH s AS ({_SCORED}),
p AS (SELECT unit_id, treatment AS t, outcome / 1000.0 AS y, row_number() OVER (ORDER BY cate DESC, unit_id) AS position FROM s),{R.draws("p", KEY, ["position", "t", "y"], 500)},
k AS (SELECT replicate, position, t, y, w, t * w AS nt, (1 - t) * w AS nc, t * w * y AS st, (1 - t) * w * y AS sc FROM boot_draws WHERE w > 0),
b AS (SELECT replicate, t, y, w, sum(nt) OVER q - nt AS nt, sum(nc) OVER q - nc AS nc, sum(st) OVER q - st AS st, sum(sc) OVER q - sc AS sc, position
  FROM k WINDOW q AS (PARTITION BY replicate ORDER BY position ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, unnest(generate_series(1, w)) AS copy FROM b),
u AS (SELECT replicate, position, copy, (st + copy * t * y) / greatest(nt + copy * t, 1) - (sc + copy * (1 - t) * y) / greatest(nc + copy * (1 - t), 1) AS u FROM c),
a AS (SELECT replicate, count(*) AS n, sum(u) AS su, max_by(u, position * 100 + copy) AS lu FROM u GROUP BY 1),
boot AS (SELECT least(greatest((su - lu / 2) / n + 0.5, 0), 1) AS area FROM a)
{R.interval("area")}"""


@query("auuc_bootstrap_ci", "ci_lower:4 ci_upper:4", "uplift_units", _AREA_INTERVAL)
def _(t: Tables):
    return U.auuc_bootstrap_ci(_scored(t).withColumn("outcome", F.col("outcome") / 1000.0), KEY)


@query(
    "identify_sensitive",
    "unit_id:i ci_lower:4 is_sensitive:b",
    "uplift_units",
    """WITH s AS (SELECT unit_id, x0 / 1000.0 AS cate FROM uplift_units),
q AS (SELECT quantile_cont(cate, 0.75) - quantile_cont(cate, 0.25) AS iqr FROM s)
SELECT unit_id, cate - 1.96 * greatest(iqr / 1.35, 1e-6) AS ci_lower,
  cate - 1.96 * greatest(iqr / 1.35, 1e-6) > 0.3 AS is_sensitive FROM s, q""",
)
def _(t: Tables):
    return U.identify_sensitive(t["uplift_units"].withColumn("cate", F.col("x0") / 1000.0))


@query(
    "identify_sensitive_fixed_model",
    "unit_id:i is_sensitive:b",
    "uplift_units",
    "SELECT unit_id, x0 / 1000.0 > 0.3 AS is_sensitive FROM uplift_units",
)
def _(t: Tables):
    return U.identify_sensitive(t["uplift_units"].withColumn("cate", F.col("x0") / 1000.0), fixed_model=True)


@query(
    "treatment_policy",
    "unit_id:i cate:4 treatment_recommended:b mean_cate:4",
    "uplift_units",
    "SELECT unit_id, x0 / 1000.0 AS cate, x0 / 1000.0 > 0.10 AS treatment_recommended, avg(x0 / 1000.0) OVER () AS mean_cate "
    "FROM uplift_units",
)
def _(t: Tables):
    return U.treatment_policy(t["uplift_units"].withColumn("cate", F.col("x0") / 1000.0))


# ---------------------------------------------------------------- explanations

_SUPPLIER_ROWS = """SELECT l_suppkey AS supplier_id, avg(l_discount) AS discount, avg(l_tax) AS tax,
  avg(l_quantity) AS quantity, avg(l_extendedprice) AS price FROM lineitem GROUP BY l_suppkey"""
SUPPLIER_FEATURES = ["discount", "tax", "quantity"]


def _supplier_model(t: Tables):
    if _model_key(t) not in _SUPPLIER_MODELS:
        # averages may differ in the last bit when taken again: fitted and explained rows are the same
        rows = materialise(t.sql(_SUPPLIER_ROWS), "supplier-rows")
        _SUPPLIER_MODELS[_model_key(t)] = rows, B.fit_regression(rows, SUPPLIER_FEATURES, "price", U.REGRESSOR, ["supplier_id"])
    return _SUPPLIER_MODELS[_model_key(t)]


@query("permutation_importance", "feature mean_abs_shap:2")
def _(t: Tables):
    rows, model = _supplier_model(t)
    return X.permutation_importance(model, rows, SUPPLIER_FEATURES, ["supplier_id"])


@query("local_surrogate", "supplier_id:i feature coefficient:2 rank:i")
def _(t: Tables):
    rows, model = _supplier_model(t)
    return X.local_surrogate(model, rows, SUPPLIER_FEATURES, ["supplier_id"])


@query("compare_explanations", "feature shap_mean_abs:2 lime_mean_abs:2 shap_rank:i lime_rank:i")
def _(t: Tables):
    rows, model = _supplier_model(t)
    importance = X.permutation_importance(model, rows, SUPPLIER_FEATURES, ["supplier_id"])
    local = X.local_surrogate(model, rows, SUPPLIER_FEATURES, ["supplier_id"])
    return X.compare_explanations(importance, local, rows.agg(F.count(F.lit(1))))
