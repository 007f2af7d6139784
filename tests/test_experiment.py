"""Bucketing, CUPED, sequential tests, interleaving and sample sizes."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendwright.functions.hashing import standard_normal
from spendwright.operators import experiment as E
from spendwright.operators import interleaving as I


@pytest.mark.parametrize("n", [1, 7, 1000, 100_000, 2**31 - 1])
def test_bucket_equals_big_integer_modulo(spark, n):
    units = spark.range(200).select(F.concat(F.lit("user_é_"), "id").alias("unit"))
    rows = E.assign_bucket(units, "unit", F.lit("salt"), n).collect()
    for r in rows:
        digest = hashlib.sha256(("salt" + r.unit).encode()).hexdigest()
        assert r.bucket == int(digest, 16) % n


def test_group_bounds_and_holdout(spark):
    units = spark.createDataFrame([(b,) for b in (0, 299, 300, 599, 600, 999)], "bucket bigint")
    groups = [r.group for r in E.assign_group(units, {"a": 0.3, "b": 0.3}).orderBy("bucket").collect()]
    assert groups == ["a", "a", "b", "b", None, None]
    with pytest.raises(ValueError):
        E.assign_group(units, {"a": 0.0})
    with pytest.raises(ValueError):
        E.assign_group(units, {"a": 0.7, "b": 0.4})


def test_salt_priority(spark):
    df = spark.createDataFrame([("known",), ("other",)], "layer string")
    layers = {"known": "L"}
    got = df.select(
        E.resolve_salt("D", layers, F.col("layer")).alias("by_layer"),
        E.resolve_salt("D", layers, F.col("layer"), "X").alias("explicit"),
        E.resolve_salt("D").alias("default"),
    ).collect()
    assert [tuple(r) for r in got] == [("L", "X", "D"), ("D", "X", "D")]


def test_srm(spark):
    def assigned(a, b):
        return spark.createDataFrame([("a",)] * a + [("b",)] * b, "group string")

    fine = E.srm_check(assigned(500, 500), {"a": 1, "b": 1}).first()
    assert fine.chi2_statistic == 0 and fine.p_value == 1.0 and not fine.is_srm
    bad = E.srm_check(assigned(600, 400), {"a": 0.5, "b": 0.5}).first()
    assert bad.chi2_statistic == pytest.approx(40.0) and bad.is_srm
    with pytest.raises(ValueError):
        E.srm_check(assigned(1, 1), {"a": 0.0, "b": 1.0})


def test_bucket_distribution_counts_empty_buckets(spark):
    rows = spark.createDataFrame([(0,), (0,), (1,)], "bucket bigint")
    row = E.bucket_distribution(rows, 4).first()
    e = 3 / 4
    assert row.min_count == 0 and row.max_count == 2
    assert row.chi2_statistic == pytest.approx(((2 - e) ** 2 + (1 - e) ** 2 + 2 * e**2) / e)
    assert row.max_deviation_pct == pytest.approx((2 - e) / e * 100)


@pytest.fixture(scope="module")
def pairs(spark):
    """Correlated pre and post metrics, correlation 0.74."""
    x = standard_normal(F.col("id"), seed=1)
    e = standard_normal(F.col("id"), seed=2)
    return spark.range(5000).select("id", (x * 10 + 50).alias("pre"), (x * 7.4 + e * 6.726 + 80).alias("post"))


def test_cuped_reduces_variance(pairs):
    rows = pairs.toPandas()
    fit = E.cuped_fit(pairs, "pre", "post").first()
    assert fit.theta == pytest.approx(np.cov(rows.post, rows.pre)[0, 1] / rows.pre.var(), rel=1e-9)
    assert fit.rho == pytest.approx(0.74, abs=0.03)
    got = E.cuped_variance_reduction(pairs, "pre", "post").first()
    assert got.variance_reduction == pytest.approx(fit.rho**2, rel=1e-6)
    assert got.remaining_variance == pytest.approx(1 - fit.rho**2)
    adjusted = E.cuped_transform(pairs, E.cuped_fit(pairs, "pre", "post"), "pre", "post")
    assert adjusted.agg(F.avg("adjusted")).first()[0] == pytest.approx(rows.post.mean())


def test_cuped_flat_covariate(pairs):
    flat = pairs.withColumn("pre", F.lit(3.0))
    fit = E.cuped_fit(flat, "pre", "post").first()
    assert fit.theta == 0.0 and fit.rho == 0.0
    assert E.cuped_variance_reduction(flat, "pre", "post").first().variance_reduction == pytest.approx(0.0)


def test_cuped_bootstrap_covers_estimate(pairs):
    row = E.cuped_bootstrap_ci(pairs, "pre", "post", ["id"], replicates=300).first()
    rho = E.cuped_fit(pairs, "pre", "post").first().rho
    assert row.ci_lower < rho**2 < row.ci_upper
    assert row.ci_upper - row.ci_lower < 0.08
    assert row.median == pytest.approx(rho**2, abs=0.01)


def _arms(spark, effect, n=2000):
    noise = standard_normal(F.col("id"), seed=9)
    arm = F.when(F.col("id") % 2 == 0, "c").otherwise("t")
    return spark.range(n).select(arm.alias("arm"), (noise + F.when(F.col("id") % 2 == 1, effect).otherwise(0.0)).alias("y"),
                                 (F.col("id") / 100).cast("int").alias("day"))


def test_msprt_finds_effect_and_no_effect(spark):
    big = E.msprt(E.arm_moments(_arms(spark, 0.5), "y", "arm", "c", "t")).first()
    assert big.should_stop and big.p_value < 0.05
    v, t = (999 * big.var_control + 999 * big.var_treatment) / 1998, 1000
    assert big.cs_upper - big.observed_delta == pytest.approx(math.sqrt((v / t) * (v + t) / v * 2 * math.log(20)))
    none = E.msprt(E.arm_moments(_arms(spark, 0.0), "y", "arm", "c", "t")).first()
    assert not none.should_stop and none.cs_lower < 0 < none.cs_upper


def test_msprt_too_little_data(spark):
    df = spark.createDataFrame([("c", 1.0), ("t", 9.0)], "arm string, y double")
    row = E.msprt(E.arm_moments(df, "y", "arm", "c", "t")).first()
    assert (row.lambda_ratio, row.p_value, row.cs_lower, row.should_stop) == (0.0, 1.0, None, False)
    empty = E.msprt(E.arm_moments(df.where("arm = 'c'"), "y", "arm", "c", "t")).first()
    assert empty.observed_delta == 0.0


def test_msprt_supplied_variance_and_clipping(spark):
    df = spark.createDataFrame([("c", 0.0), ("c", 0.0), ("t", 1e6), ("t", 1e6)], "arm string, y double")
    row = E.msprt(E.arm_moments(df, "y", "arm", "c", "t"), pooled_variance=1.0).first()
    assert row.lambda_ratio == pytest.approx(math.exp(500))


def test_peeking_curve_ends_at_the_batch_result(spark):
    df = _arms(spark, 0.2)
    curve = E.msprt_peeking_curve(df, "y", "arm", "c", "t", "day").orderBy("day").collect()
    batch = E.msprt(E.arm_moments(df, "y", "arm", "c", "t")).first()
    assert len(curve) == 20
    assert curve[-1].lambda_ratio == pytest.approx(batch.lambda_ratio, rel=1e-6)
    assert [r.n_control for r in curve] == [50 * (i + 1) for i in range(20)]


def test_sample_size_formula_and_monotony(spark):
    base = spark.createDataFrame([("s", 100.0, 30.0), ("bad", 0.0, 1.0)],
                                 "segment string, baseline_mean double, baseline_std double")
    rows = E.required_sample_size(base, 0.05, rho=0.74).collect()
    z = 1.959963984540054 + 0.8416212335729143
    n = math.ceil(z**2 * 2 * 900 / 25)
    assert rows[0].n_per_group_raw == n
    assert rows[0].n_per_group_cuped == math.ceil(n * (1 - 0.74**2))
    assert rows[1].n_per_group_raw is None
    table = E.mde_table(base.where("segment = 's'").withColumn("traffic", F.lit(100)), daily_traffic="traffic").collect()
    assert [r.mde_pct for r in table] == [3.0, 5.0, 10.0]
    sizes = [r.n_per_group_raw for r in table]
    assert sizes == sorted(sizes, reverse=True)
    assert table[1].experiment_days_raw == math.ceil(2 * n / 100)
    more = E.required_sample_size(base, 0.05, power=0.95, rho=0.74).first()
    assert more.n_per_group_raw > n
    with pytest.raises(ValueError):
        E.mde_table(base, [0.0])
    with pytest.raises(ValueError):
        E.required_sample_size(base, 0.05, power=1.0)


def test_experiment_report_equals_two_pass(spark, pairs):
    df = E.assign_batch(pairs.withColumn("x", F.lit("e")), "id", {"control": 0.5, "treatment": 0.5}, "s")
    row = E.experiment_report(df, "pre", "post", {"control": 0.5, "treatment": 0.5}, "control", "treatment", ["x"]).first()
    adjusted = E.cuped_transform(df, E.cuped_fit(df, "pre", "post"), "pre", "post")
    two_pass = E.msprt(E.arm_moments(adjusted, "adjusted", "group", "control", "treatment")).first()
    assert row.lambda_ratio == pytest.approx(two_pass.lambda_ratio, rel=1e-6)
    assert row.observed_delta == pytest.approx(two_pass.observed_delta, abs=1e-9)
    assert row.srm_passed and row.decision == "sequential_test"
    few = E.experiment_report(df.limit(100), "pre", "post", {"control": 0.5, "treatment": 0.5}, "control", "treatment", ["x"]).first()
    assert few.decision == "collect_more" and few.p_value is None


# ---------------------------------------------------------------- interleaving


def test_draft_rules():
    merged, a, b = I.draft(["x", "y", "z"], ["y", "w", "x"], {"x", "y"}, True, 4)
    assert merged == ["x", "y", "z", "w"]
    assert a == ["x", "y", "z"] and b == ["x", "y", "w"]
    assert I.draft(["x"], ["x", "y"], {"x"}, True, 3)[0] == ["x", "y"]  # A has nothing left


def test_team_draft(spark):
    rows = [(s, ["a", "b", "c"], ["c", "b", "d"], s % 2) for s in range(20)]
    ranks = spark.createDataFrame(rows, "session int, ranking_a array<string>, ranking_b array<string>, coin int")
    got = I.team_draft(ranks, "session", 4, coin="coin").collect()
    for r in got:
        # When B starts, A has nothing left to pick after three documents.
        assert len(r.interleaved) == len(set(r.interleaved)) == (4 if r.session % 2 else 3)
        assert set(r.team_a) | set(r.team_b) == set(r.interleaved)
        assert r.interleaved[0] == ("a" if r.session % 2 else "c")
    seeded = {tuple(r.interleaved) for r in I.team_draft(ranks.drop("coin"), "session", 4, seed=3).collect()}
    assert seeded <= {tuple(r.interleaved) for r in got} and len(seeded) == 2
    with pytest.raises(ValueError):
        I.team_draft(ranks, "session", 0)


def test_truncated_rankings_draft_like_whole_ones(spark):
    docs = [(s, f"d{i}", (i * 7 + s) % 11, (i * 5 + s * 3) % 13) for s in range(10) for i in range(11)]
    scores = spark.createDataFrame(docs, "session int, doc string, a int, b int")
    whole = I.team_draft(I.ranked_lists(scores, "session", "doc", "a", "b", 11), "session", 5)
    top = I.team_draft(I.ranked_lists(scores, "session", "doc", "a", "b", 5), "session", 5)
    assert sorted(map(str, whole.collect())) == sorted(map(str, top.collect()))


def test_delta_and_experiment(spark):
    shown = spark.createDataFrame(
        [(1, "x", True, False), (1, "y", True, True), (2, "x", False, True), (3, "x", True, False)],
        "session int, doc string, in_a boolean, in_b boolean")
    clicks = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x"), (9, "q")], "session int, doc string")
    rows = {r.session: r for r in I.interleaving_delta(shown, clicks, "session").collect()}
    assert (rows[1].clicks_a, rows[1].clicks_b) == (3, 1)
    assert rows[1].delta == pytest.approx(-0.5) and rows[2].delta == pytest.approx(1.0) and rows[3].delta == 0.0
    same = spark.createDataFrame([(0.5, 1, 2)] * 5, "delta double, clicks_a int, clicks_b int")
    row = I.interleaving_experiment(same).first()
    assert (row.t_statistic, row.p_value, row.winner, row.total_clicks_b) == (0.0, 1.0, "tie", 10)
    clear = spark.createDataFrame([(0.5 + 0.01 * (i % 3), 1, 2) for i in range(20)], "delta double, clicks_a int, clicks_b int")
    assert I.interleaving_experiment(clear).first().winner == "B"
