"""Treatment effects, uplift learners and explanations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from spendwright.functions.hashing import standard_normal, unit_interval
from spendwright.operators import causal as C
from spendwright.operators import explain as X
from spendwright.operators import uplift as U
from spendwright.operators.bootstrap import replicate_weights


@pytest.fixture(scope="module")
def confounded(spark):
    """Outcome = 2 T + 1.5 C + noise, treatment depends on C."""
    c = standard_normal(F.col("id"), seed=1)
    df = spark.range(2000).withColumn("c", c).withColumn("u", unit_interval(F.col("id"), seed=4))
    df = df.withColumn("t", F.when(F.col("u") < 1 / (1 + F.exp(-F.col("c"))), 1).otherwise(0))
    return df.withColumn("y", 2.0 * F.col("t") + 1.5 * F.col("c") + standard_normal(F.col("id"), seed=3) * 0.5).drop("u")


def test_ate_near_truth_and_equal_numpy(confounded):
    row = C.ate_ols(confounded, "t", "y", ["c"]).first()
    assert row.ate == pytest.approx(2.0, abs=0.1)
    pdf = confounded.toPandas()
    design = np.column_stack([np.ones(len(pdf)), pdf.c, pdf.t])
    assert row.ate == pytest.approx(np.linalg.lstsq(design, pdf.y, rcond=None)[0][-1], rel=1e-9)
    naive = C.ate_ols(confounded, "t", "y", []).first().ate
    assert naive > 2.5


def test_ate_by_group(confounded):
    both = confounded.withColumn("g", F.col("id") % 2).withColumn("y", F.col("y") + F.col("t") * F.col("g"))
    rows = {r.g: r.ate for r in C.ate_ols(both, "t", "y", ["c"], by=["g"]).collect()}
    assert rows[1] - rows[0] == pytest.approx(1.0, abs=0.15)


def test_missing_columns_fail_early(confounded):
    with pytest.raises(ValueError, match="zz"):
        C.causal_columns_check(confounded, "t", "y", ["zz"])
    with pytest.raises(ValueError, match="unknown refutation"):
        C.refute(confounded, "magic", "t", "y", ["c"], ["id"])


def test_report_refutations_pass(confounded):
    rows = {r.method: r for r in C.causal_report(confounded, "t", "y", ["c"], ["id"], replicates=200).collect()}
    assert set(rows) == set(C.METHODS)
    for r in rows.values():
        assert r.ci_lower < r.orig_ate < r.ci_upper and 0 <= r.pvalue <= 1
    assert abs(rows["placebo_treatment"].new_ate) < 0.2
    assert rows["random_common_cause"].passed
    assert rows["data_subset"].new_ate == pytest.approx(2.0, abs=0.15)


@pytest.fixture(scope="module")
def treated(spark):
    x0, x1 = standard_normal(F.col("id"), seed=1), standard_normal(F.col("id"), seed=2)
    df = spark.range(1500).withColumn("x0", x0).withColumn("x1", x1)
    df = df.withColumn("treatment", (unit_interval(F.col("id"), seed=7) < 0.3).cast("int"))
    return df.withColumn("outcome", 2 + F.col("x0") + F.col("treatment") * (F.col("x0") * 2 + 1)
                         + standard_normal(F.col("id"), seed=5) * 0.1)


@pytest.fixture(scope="module")
def model(treated, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    return U.UpliftModel(["x0", "x1"], params={"maxIter": 8, "stepSize": 0.3}, folder=folder).fit(treated)


@pytest.mark.parametrize("learner", U.LEARNERS)
def test_learners_follow_the_true_effect(treated, model, learner):
    scored = model.predict_cate(treated, learner).withColumn("truth", F.col("x0") * 2 + 1)
    assert scored.columns == [*treated.columns, "cate", "truth"]
    assert scored.agg(F.corr("cate", "truth")).first()[0] > 0.7


def test_learner_errors(treated, model):
    with pytest.raises(ValueError):
        model.predict_cate(treated, "z_learner")
    with pytest.raises(RuntimeError):
        U.UpliftModel(["x0"]).predict_cate(treated, "s_learner")


def _numpy_auuc(cate, t, y):
    order = np.argsort(-cate, kind="stable")
    t, y = t[order], y[order]
    u = np.cumsum(t * y) / np.maximum(np.cumsum(t), 1) - np.cumsum((1 - t) * y) / np.maximum(np.cumsum(1 - t), 1)
    u = np.concatenate([[0], u])
    return np.clip(np.mean((u[1:] + u[:-1]) / 2) + 0.5, 0, 1)


def test_auuc_equals_numpy_with_ties(treated):
    scored = treated.withColumn("cate", F.round("x0")).withColumn("outcome", F.col("outcome") / 20)
    pdf = scored.orderBy("id").toPandas()
    want = _numpy_auuc(pdf.cate.to_numpy(), pdf.treatment.to_numpy(), pdf.outcome.to_numpy())
    assert 0 < want < 1
    row = U.auuc(scored, ["id"]).first()
    assert row.auuc == pytest.approx(want, rel=1e-9) and row.n_units == 1500
    low, high = U.auuc_bootstrap_ci(scored, ["id"], replicates=200).first()
    assert low < want < high
    assert U.auuc(scored.where("treatment = 1"), ["id"]).first().auuc == 0.5
    assert U.uplift_curve(scored, ["id"]).agg(F.max("fraction")).first()[0] == 1.0


def test_auuc_interval_equals_numpy(spark):
    rng = np.random.default_rng(4)
    n = 5000
    pdf = pd.DataFrame({"id": np.arange(n), "treatment": (rng.random(n) < 0.3).astype(int), "cate": np.round(rng.normal(size=n), 1)})
    pdf["outcome"] = rng.normal(size=n) * 0.1 + 0.05 * pdf.treatment * pdf.cate
    weights = replicate_weights([str(i) for i in pdf.id], 30, 7)
    order = np.lexsort((pdf.id, -pdf.cate))
    areas = []
    for r in range(30):
        rows = np.repeat(order, weights[order, r].astype(int))
        t, y = pdf.treatment.to_numpy()[rows], pdf.outcome.to_numpy()[rows]
        areas.append(_numpy_auuc(-np.arange(len(rows)), t, y))
    ranked = U.rank_units(spark.createDataFrame(pdf), ["id"])
    for chunk in (700, 50_000):
        low, high = U.area_interval(ranked, ["id"], 30, seed=7, chunk=chunk).first()
        assert (low, high) == pytest.approx(tuple(np.quantile(areas, [0.025, 0.975])), rel=1e-9)


def test_stored_models_are_read_not_fitted_again(treated, tmp_path, monkeypatch):
    options = {"params": {"maxIter": 2}, "folder": str(tmp_path)}
    first = U.UpliftModel(["x0", "x1"], **options).fit(treated, ["x_learner"])
    fitted = []
    fit_part = U.UpliftModel._fit_part
    monkeypatch.setattr(U.UpliftModel, "_fit_part", lambda self, part, *a: fitted.append(part) or fit_part(self, part, *a))
    again = U.UpliftModel(["x0", "x1"], **options).fit(treated.repartition(3), ["t_learner", "x_learner"])
    assert not fitted
    a, b = (m.predict_cate(treated).orderBy("id").toPandas().cate for m in (first, again))
    assert np.array_equal(a, b)
    U.UpliftModel(["x0", "x1"], **options).fit(treated.where("id > 3"), ["t_learner"])
    assert sorted(fitted) == ["control", "treated"]


def test_ablation(treated, model):
    rows = U.uplift_ablation(model, treated, ["id"], replicates=50, learners=["s_learner", "x_learner"]).collect()
    assert rows[0].auuc >= rows[1].auuc
    assert {r.target_auuc for r in rows} == {0.62, 0.74}
    for r in rows:
        assert r.within_target == (abs(r.auuc - r.target_auuc) <= 0.05) and r.ci_width >= 0


def test_sensitive_and_policy(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "cate double")
    got = U.identify_sensitive(df, 0.3)
    bound = 1.96 * 50 / 1.35
    assert got.where("is_sensitive").count() == sum(i - bound > 0.3 for i in range(101))
    assert U.identify_sensitive(df, 0.3, fixed_model=True).where("is_sensitive").count() == 100
    row = U.treatment_policy(df).orderBy("cate").first()
    assert not row.treatment_recommended and row.mean_cate == 50.0


@pytest.fixture(scope="module")
def linear(spark):
    """y = 2 a + 0.5 b + noise; c is irrelevant."""
    df = spark.range(400)
    for i, n in enumerate("abc"):
        df = df.withColumn(n, standard_normal(F.col("id"), seed=i + 1))
    df = df.withColumn("y", 2 * F.col("a") + 0.5 * F.col("b") + standard_normal(F.col("id"), seed=9) * 0.01)
    stages = [VectorAssembler(inputCols=list("abc"), outputCol="f"), LinearRegression(featuresCol="f", labelCol="y")]
    return df, Pipeline(stages=stages).fit(df)


def test_explanations_find_the_top_feature(linear):
    df, fitted = linear
    importance = X.permutation_importance(fitted, df, list("abc"), ["id"])
    assert [r.feature for r in importance.collect()] == ["a", "b", "c"]
    local = X.local_surrogate(fitted, df.limit(20), list("abc"), ["id"], perturbations=200)
    coefs = {(r.id, r.feature): r.coefficient for r in local.collect()}
    assert len(coefs) == 60
    for (_, f), v in coefs.items():
        assert v == pytest.approx({"a": 2.0, "b": 0.5, "c": 0.0}[f], abs=0.05)
    both = X.compare_explanations(importance, local, df.limit(20).agg(F.count(F.lit(1))), top_n=2).collect()
    assert [(r.feature, r.shap_rank, r.lime_rank) for r in both] == [("a", 1, 1), ("b", 2, 2)]
    with pytest.raises(ValueError):
        X.compare_explanations(importance, local, df.agg(F.count(F.lit(1))), top_n=0)


def test_copies_add_up_without_a_pass_per_copy():
    rng = np.random.default_rng(3)
    w = rng.poisson(1.0, (40, 6)).astype(float)
    w[0, 0] = 7.0
    y, n, s = rng.normal(size=(40, 1)), rng.integers(0, 5, (40, 6)).astype(float), rng.normal(size=(40, 6))
    want = [sum((s[i, r] + k * y[i, 0]) / (n[i, r] + k) for i in range(40) for k in range(1, int(w[i, r]) + 1)) for r in range(6)]
    assert U._copies(w, y, n, s) == pytest.approx(want, rel=1e-12)
