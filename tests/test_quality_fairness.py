"""Contracts, expectation suites and fairness tests."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendwright.operators import fairness as Y
from spendwright.operators import quality as Q
from spendwright.operators.cost_tracking import ACTIONS
from spendwright.sources.contracts import ACTION_TYPES, CONTRACTS, spark_schema


def _failures(df):
    return {(r.column, r.check): r.failures for r in df.collect() if r.failures}


def test_contract_passes_and_fails(spark):
    good = ("TXN_1", dt.date(2024, 1, 1), "SKU_1", "PLT_1", "SUP_1", 1.0, 0.0, 1.0, 1.0, 3.0, 5)
    bad = ("X_1", None, "SKU_1", None, "SUP_1", -1.0, 0.0, 1.0, 1.0, 0.0, 0)
    contract = CONTRACTS["fact_cost_transactions"]
    df = spark.createDataFrame([good, bad], spark_schema(contract))
    assert _failures(Q.contract_check(df, contract, "t")) == {
        ("transaction_id", "prefix"): 1, ("transaction_date", "not_null"): 1, ("plant_id", "not_null"): 1,
        ("raw_material_cost", "ge"): 1, ("total_unit_cost", "gt"): 1, ("volume", "gt"): 1}
    assert _failures(Q.contract_check(df.limit(1), contract, "t")) == {}
    failed = Q.failing_rows(df, contract).first()
    assert failed.transaction_id == "X_1" and "volume:gt" in failed["_failed"]
    assert _failures(Q.contract_check(df.drop("volume"), contract, "t"))["volume", "present"] == 2


def test_contract_coercion_unique_nullable(spark):
    contract = {"sku_id": CONTRACTS["dim_product"]["sku_id"], "moq": CONTRACTS["dim_product"]["moq"],
                "saved": CONTRACTS["fact_cost_reduction_actions"]["actual_savings_pct"]}
    df = spark.createDataFrame([("SKU_1", "3", "0.1"), ("SKU_1", "x", None), ("SKU_2", "4", "2.0")],
                               "sku_id string, moq string, saved string")
    assert _failures(Q.contract_check(df, contract, "t")) == {
        ("sku_id", "unique"): 1, ("moq", "type"): 1, ("saved", "between"): 1}


def test_validate_all(spark):
    c = {"a": {"x": CONTRACTS["dim_plant"]["overhead_rate"]}, "b": {"x": CONTRACTS["dim_plant"]["overhead_rate"]}}
    tables = {"a": spark.createDataFrame([(0.5,)], "x double"), "b": spark.createDataFrame([(1.5,)], "x double")}
    assert {r.table: r.valid for r in Q.validate_all(tables, c).collect()} == {"a": True, "b": False}


def test_twelve_contracts_and_action_words():
    assert len(CONTRACTS) == 12
    assert set(ACTION_TYPES) == {a["action_type"] for a in ACTIONS}


def _expect(spark, kind, kwargs, rows, schema):
    suite = Q.load_suite(json.dumps({"expectations": [{"expectation_type": kind, "kwargs": kwargs}]}))
    return Q.run_suite(spark.createDataFrame(rows, schema), suite).first()


@pytest.mark.parametrize(
    "kind, kwargs, values, success, observed",
    [
        ("expect_column_values_to_be_between", {"column": "a", "min_value": 0, "max_value": 2, "mostly": 0.6},
         [0.0, 2.0, 3.0, None], True, 0.6667),
        ("expect_column_values_to_be_between", {"column": "a", "min_value": 0}, [None], False, None),
        ("expect_column_values_to_not_be_null", {"column": "a"}, [1.0, None], False, 1),
        ("expect_column_values_to_be_unique", {"column": "a"}, [1.0, 1.0, None, None], False, 2),
        ("expect_column_values_to_be_in_set", {"column": "a", "value_set": [1.0]}, [1.0, None], True, 0),
        ("expect_column_distinct_values_to_be_in_set", {"column": "a", "value_set": [1.0]}, [1.0, 2.0], False, 1),
        ("expect_column_mean_to_be_between", {"column": "a", "min_value": 1, "max_value": 2}, [1.0, 2.0, None], True, 1.5),
        ("expect_column_proportion_of_unique_values_to_be_between", {"column": "a", "min_value": 0.6}, [1.0, 1.0, None], False, 0.5),
        ("expect_table_row_count_to_be_between", {"min_value": 2}, [1.0, 2.0], True, 2),
        ("expect_column_values_to_not_be_null", {"column": "zz"}, [1.0], False, None),
        ("expect_the_moon", {}, [1.0], True, None),
        ("expect_table_columns_to_match_ordered_list", {"column_list": ["a"]}, [1.0], True, 1),
        ("expect_table_columns_to_match_ordered_list", {"column_list": ["b"]}, [1.0], False, 1),
    ],
)
def test_expectations(spark, kind, kwargs, values, success, observed):
    row = _expect(spark, kind, kwargs, [(v,) for v in values], "a double")
    assert row.success is success
    assert row.observed == (pytest.approx(observed) if observed is not None else None)


def test_regex_and_pairs(spark):
    row = _expect(spark, "expect_column_values_to_match_regex", {"column": "s", "regex": "a|b", "mostly": 0.5},
                  [("ax",), ("xb",)], "s string")
    assert row.success and row.observed == 0.5
    empty = _expect(spark, "expect_column_values_to_match_regex", {"column": "s", "regex": "a"}, [(None,)], "s string")
    assert not empty.success and empty.observed == 0.0
    kind = "expect_column_pair_values_a_to_be_greater_than_b"
    pair = {"column_A": "a", "column_B": "b"}
    assert _expect(spark, kind, pair, [(2, 1), (1, 1)], "a int, b int").observed == 1
    assert _expect(spark, kind, {**pair, "or_equal": True}, [(2, 1), (1, 1)], "a int, b int").success
    assert not _expect(spark, kind, pair, [(2, None)], "a int, b int").success
    assert _expect(spark, kind, {**pair, "column_B": "q"}, [(2, 1)], "a int, b int").note == "Column(s) not found"


def test_summary(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    suite = {"expectations": [
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": c}} for c in ("a", "b", "a")]}
    row = Q.suite_summary(Q.run_suite(df, suite), "s").first()
    assert (row.success, row.total_expectations, row.passed, row.failed, row.success_rate) == (False, 3, 2, 1, 0.6667)


# ---------------------------------------------------------------- fairness


@pytest.fixture(scope="module")
def errors(spark):
    rows = [(i, "good" if i % 2 else "bad", 100.0, 100.0 + (30.0 if i % 2 == 0 else 2.0) + i % 5) for i in range(200)]
    return spark.createDataFrame(rows, "id int, g string, y_true double, y_pred double")


def test_group_mape_and_interval(errors):
    rows = Y.group_mape_ci(errors, "g", ["id"], replicates=200).orderBy("mape").collect()
    assert [r.g for r in rows] == ["good", "bad"]
    assert rows[1].mape == pytest.approx(32.0) and rows[1].n_samples == 100
    for r in rows:
        assert r.ci_lower < r.mape < r.ci_upper


def test_small_actuals_use_the_floor(spark):
    df = spark.createDataFrame([("g", 0.1, 0.6)], "g string, y_true double, y_pred double")
    assert Y.group_mape(df, "g").first().mape == pytest.approx(50.0)


def _kruskal(groups):
    values = np.concatenate(groups)
    order = values.argsort(kind="stable")
    ranks = np.empty(len(values))
    ranks[order] = np.arange(1, len(values) + 1)
    for v in np.unique(values):
        ranks[values == v] = ranks[values == v].mean()
    n, start, h = len(values), 0, 0.0
    for g in groups:
        h += ranks[start : start + len(g)].sum() ** 2 / len(g)
        start += len(g)
    _, t = np.unique(values, return_counts=True)
    return (12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))


def test_kruskal(errors):
    row = Y.kruskal_wallis(errors, "g").first()
    apes = {g: np.array([abs(r.y_true - r.y_pred) / r.y_true for r in errors.where(F.col("g") == g).collect()]) for g in ("bad", "good")}
    assert row.H == pytest.approx(_kruskal([apes["bad"], apes["good"]]))
    assert row.p_value < 1e-6 and row.n_groups == 2
    with pytest.raises(Exception, match="at least 2 groups"):
        Y.kruskal_wallis(errors.where("g = 'bad'"), "g").collect()


def test_chi_squared(errors):
    row = Y.chi_squared_error_bins(errors, "g").first()
    e = np.array([(abs(r.y_true - r.y_pred) / r.y_true, r.g == "bad") for r in errors.collect()])
    edges = np.unique(np.quantile(e[:, 0], np.linspace(0, 1, 5)))
    bins = np.digitize(e[:, 0], edges[1:-1])
    table = np.array([[np.sum((bins == b) & (e[:, 1] == g)) for b in np.unique(bins)] for g in (0, 1)])
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    assert row.chi2 == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert row.dof == table.shape[1] - 1 and row.p_value < 1e-6
    flat = errors.withColumn("y_pred", F.lit(110.0))
    one = Y.chi_squared_error_bins(flat, "g").first()
    assert (one.chi2, one.dof, one.p_value) == (0.0, 0, 1.0)


def test_slices_overlap_and_skip_empty(errors):
    slices = {"all": F.lit(True), "bad": F.col("g") == "bad", "none": F.col("y_true") < 0}
    rows = {r.segment: r.n_samples for r in Y.slice_fairness(errors, slices).collect()}
    assert rows == {"all": 200, "bad": 100}
    with pytest.raises(ValueError):
        Y.in_slices(errors, {})


def test_undefined_errors_do_not_count(spark):
    from spendwright.operators import fairness

    rows = [("a", 10.0, 9.0), ("a", 20.0, 25.0), ("a", 30.0, 30.5), ("b", 10.0, 12.0), ("b", 20.0, 21.0), ("b", 5.0, 9.0)]
    odd = [("a", None, 1.0), ("b", float("nan"), 1.0), (None, 5.0, 1.0), ("b", 1.0, None)]
    schema = "g string, y_true double, y_pred double"
    plain, mixed = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + odd, schema)
    for test in (fairness.kruskal_wallis, fairness.chi_squared_error_bins, fairness.group_mape):
        assert test(plain, "g").collect() == test(mixed, "g").collect()


def test_nan_is_missing_in_contracts(spark):
    from spendwright.operators.quality import Rule, contract_check

    df = spark.createDataFrame([(1.0,), (float("nan"),), (-1.0,)], "x double")
    found = {r["check"]: r["failures"] for r in contract_check(df, {"x": Rule("double", gt=0.0)}, "t").collect()}
    assert found["not_null"] == 1 and found["gt"] == 1 and found["type"] == 0
