"""Cost models and tracking on small frames with hand-computed answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendwright.operators import cost_model as M
from spendwright.operators import cost_tracking as K
from spendwright.operators import reports as R
from spendwright.plans.reports import explain_report, report, run_all_reports

D = dt.date


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(
        [
            ("SKU_1", 100.0, 120.0, "Steel", 0.5, 0.4, 0.2, 0.1, "A"),
            ("SKU_2", 50.0, 40.0, "Unobtainium", 0.0, 0.0, 0.0, 0.0, "B"),
        ],
        "sku_id string, base_unit_cost double, target_cost double, commodity_exposure string, "
        "commodity_sensitivity double, labor_intensity double, overhead_allocation double, tariff_exposure double, "
        "category string",
    )


@pytest.fixture(scope="module")
def plants(spark):
    return spark.createDataFrame([("PLT_1", 30.0, 0.5)], "plant_id string, labor_rate_hourly double, overhead_rate double")


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame(
        [(D(2024, 1, 1), "Steel", 9.0), (D(2024, 2, 1), "Steel", 1.2)],
        "price_date date, commodity string, price_index double",
    )


def test_decompose_elements(products, plants, prices):
    row = M.should_cost_decompose(products, plants, prices, "PLT_1").where("sku_id = 'SKU_1'").first()
    assert row.raw_material_cost == pytest.approx(100 * 0.5 * (1 + 0.2 * 0.5))
    assert row.labor_cost == pytest.approx(100 * 0.4 * 2)
    assert row.overhead_cost == pytest.approx(100 * 0.2 * 1.5)
    assert row.logistics_cost == 5.0 and row.tariff_cost == 10.0
    parts = row.raw_material_cost + row.labor_cost + row.overhead_cost + row.logistics_cost + row.tariff_cost
    assert row.total_should_cost == pytest.approx(parts)
    assert row.current_actual_cost == 120.0
    assert row.gap_pct == pytest.approx((120 - parts) / parts, abs=1e-4)


def test_unknown_plant_and_commodity_use_defaults(spark, products, plants, prices):
    row = M.should_cost_decompose(products, plants, prices, "nowhere").where("sku_id = 'SKU_1'").first()
    assert row.labor_cost == pytest.approx(40.0)
    assert row.overhead_cost == pytest.approx(26.0)
    no_prices = M.should_cost_decompose(products, plants, prices.where("false"), "PLT_1").where("sku_id = 'SKU_1'").first()
    assert no_prices.raw_material_cost == pytest.approx(50.0)


def test_missing_target_is_marked_up(products, plants, prices):
    row = M.should_cost_decompose(products.drop("target_cost"), plants, prices, "PLT_1").first()
    assert row.current_actual_cost == pytest.approx(row.total_should_cost * 1.1)


def test_benchmark_and_gaps(products, plants, prices):
    breakdowns = M.should_cost_decompose(products, plants, prices, "PLT_1")
    rows = M.should_cost_benchmark(breakdowns).collect()
    assert [r.sku_id for r in rows] == ["SKU_2", "SKU_1"]
    assert {r.sku_id: r.largest_element for r in rows} == {"SKU_1": "labor", "SKU_2": "logistics"}
    assert [r.sku_id for r in M.should_cost_gaps(breakdowns).collect()] == ["SKU_2"]


def test_largest_element_tie_takes_first(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    assert df.select(M.largest_of({"a": F.col("a"), "b": F.col("b")})).first()[0] == "a"


@pytest.fixture(scope="module")
def quotes(spark):
    return spark.createDataFrame(
        [
            (D(2024, 1, 1), "SUP_1", "SKU_1", 10.0, 3),
            (D(2024, 3, 1), "SUP_1", "SKU_1", 130.0, 8),
            (D(2024, 2, 1), "SUP_2", "SKU_1", 110.0, 20),
        ],
        "quote_date date, supplier_id string, sku_id string, quoted_price double, lead_time_days int",
    )


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        [("SKU_1", "PLT_1", "SUP_2", 0.2), ("SKU_1", "PLT_9", "SUP_2", 0.0), ("SKU_2", "PLT_9", "SUP_1", 0.1)],
        "sku_id string, plant_id string, supplier_id string, defect_rate double",
    )


def test_latest_quote_then_cheapest(quotes):
    row = M.best_supplier_quote(quotes).first()
    assert (row.best_supplier, row.quoted_price, row.lead_time_days) == ("SUP_2", 110.0, 20)


def test_make_vs_buy(spark, products, plants, quotes, events):
    pairs = spark.createDataFrame([("SKU_1", "PLT_1"), ("SKU_2", "PLT_1"), ("SKU_9", "PLT_1"), ("SKU_1", "X")],
                                  "sku_id string, plant_id string")
    rows = {r.sku_id: r for r in M.make_vs_buy(pairs, products, plants, quotes, events).collect()}
    assert set(rows) == {"SKU_1", "SKU_2"}  # unknown ids have no result
    one = rows["SKU_1"]
    assert one.make_cost == pytest.approx(100 * (1 + 0.4 * 1 + 0.5))
    assert one.buy_cost == 110.0 and one.cost_advantage == "buy"
    assert one.quality_score_make == 0.8 and one.quality_score_buy == 0.9
    assert one.lead_time_make == 9 and one.lead_time_buy == 20
    assert one.breakeven_volume == int(100 * 0.5 * 100 / 80)
    make = 0.35 * 0 + 0.3 * 0.8 + 0.2 * (1 - 9 / 20) + 0.15 * 0.7
    assert one.composite_score_make == pytest.approx(make, abs=1e-4)
    two = rows["SKU_2"]
    assert two.buy_cost == pytest.approx(57.5) and two.lead_time_buy == 14
    assert two.quality_score_make == 0.92 and two.quality_score_buy == 0.9


def test_make_vs_buy_weights_and_no_events(spark, products, plants, quotes):
    pairs = spark.createDataFrame([("SKU_1", "PLT_1")], "sku_id string, plant_id string")
    weights = {"cost": 1.0, "quality": 0.0, "lead_time": 0.0, "strategic": 0.0}
    row = M.make_vs_buy(pairs, products, plants, quotes, None, weights).first()
    assert row.recommendation == "buy" and row.quality_score_buy == 0.92
    grid = M.make_vs_buy_sensitivity(M.make_vs_buy(pairs, products, plants, quotes), 0.2, 5).collect()
    assert [r.cost_change_pct for r in grid] == [-0.2, -0.16, -0.12, -0.08, -0.04, 0.0, 0.04, 0.08, 0.12, 0.16, 0.2]
    assert {r.recommendation for r in grid} <= {"make", "buy"}


@pytest.fixture(scope="module")
def transactions(spark):
    return spark.createDataFrame(
        [
            (D(2024, 1, 10), "SKU_1", 130.0, 2),
            (D(2024, 1, 20), "SKU_2", 30.0, 1),
            (D(2024, 3, 5), "SKU_9", 50.0, 3),
            (D(2024, 3, 6), "SKU_1", 110.0, 1),
        ],
        "transaction_date date, sku_id string, total_unit_cost double, volume int",
    )


def test_ocogs_variance(transactions, products):
    row = K.ocogs_variance(transactions, products).first()
    actual, budget = 260 + 30 + 150 + 110, 240 + 40 + 150 + 120
    assert (row.total_actual, row.total_budget) == (actual, budget)
    assert row.variance_pct == pytest.approx((actual - budget) / budget, abs=1e-4)
    assert row.favorable and row.period_start == D(2024, 1, 10) and row.period_end == D(2024, 3, 6)


def test_ocogs_variance_empty_period(transactions, products):
    row = K.ocogs_variance(transactions, products, D(2030, 1, 1), D(2030, 2, 1)).first()
    assert (row.total_actual, row.total_budget, row.variance_pct, row.favorable) == (0.0, 0.0, 0.0, True)


def test_ocogs_by_category_drops_unknown(transactions, products):
    rows = {r.category: r.variance_pct for r in K.ocogs_variance_by_category(transactions, products).collect()}
    assert rows == {"A": pytest.approx(370 / 360 - 1, abs=1e-4), "B": pytest.approx(-0.25)}


def test_ocogs_trend_keeps_empty_months(transactions):
    rows = K.ocogs_trend(transactions, 12).collect()
    assert [r.period for r in rows] == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31)]
    assert rows[1].avg_unit_cost is None and rows[1].volume == 0 and rows[1].cost_change_pct == 0.0
    assert rows[2].cost_change_pct == pytest.approx(0.0)
    assert len(K.ocogs_trend(transactions, 1).collect()) == 1  # cutoff 6 February


def test_outliers(spark):
    flat = spark.createDataFrame([(5.0,)] * 4, "total_unit_cost double")
    assert K.ocogs_outliers(flat).count() == 0
    spiked = spark.createDataFrame([(10.0 + i % 3,) for i in range(50)] + [(99.0,)], "total_unit_cost double")
    rows = K.ocogs_outliers(spiked, 2.5).collect()
    assert [r.total_unit_cost for r in rows] == [99.0]


@pytest.fixture(scope="module")
def actions(spark):
    return spark.createDataFrame(
        [
            (1, "automation", 0.2, 0.5, "completed"),
            (2, "automation", 0.2, None, "completed"),
            (3, "nearshoring", 0.1, 0.9, "proposed"),
        ],
        "action_id int, action_type string, projected_savings_pct double, actual_savings_pct double, status string",
    )


def test_action_scores_use_history(products, actions):
    scores = K.action_scores(products, actions)
    rows = {r.action_type: r for r in scores.where("sku_id = 'SKU_1'").collect()}
    assert len(rows) == 8
    assert rows["automation"].estimated_savings_pct == pytest.approx(0.5 * 0.4)
    assert rows["automation"].confidence == 0.5 and rows["nearshoring"].confidence == 0.2
    assert rows["nearshoring"].estimated_savings_pct == pytest.approx(0.07 * 1.2)
    assert rows["automation"].rationale.startswith("Labor-intensive (40%)")
    assert rows["negotiate_contract"].rationale == "Contract renegotiation for volume/term improvements"


def test_recommend_is_ranked_and_limited(products, actions):
    best = K.recommend_actions(K.action_scores(products, actions), 3)
    for sku in ("SKU_1", "SKU_2"):
        rows = best.where(F.col("sku_id") == sku).orderBy("rank").collect()
        assert len(rows) == 3
        savings = [r.estimated_savings_pct for r in rows]
        assert savings == sorted(savings, reverse=True)


def test_estimate_savings_unknown_is_zero(spark, products, actions):
    requests = spark.createDataFrame(
        [("SKU_1", "automation"), ("SKU_1", "magic"), ("none", "automation")], "sku_id string, action_type string"
    )
    rows = {(r.sku_id, r.action_type): r for r in K.estimate_savings(requests, K.action_scores(products, actions)).collect()}
    assert rows["SKU_1", "automation"].estimated_savings_pct == 0.2
    assert rows["SKU_1", "automation"].historical_avg == 0.5
    assert rows["SKU_1", "magic"].confidence == 0.0 and rows["none", "automation"].estimated_savings_pct == 0.0


def test_realization(actions):
    row = K.realization_tracking(actions).first()
    assert (row.action_type, row["count"], row.avg_projected, row.avg_actual, row.realization_rate) == (
        "automation", 2, 0.2, 0.5, 2.5)


def _elastic(spark, sku, slope, n, noise=0.0):
    return [(sku, float(p), 1000.0 * p**slope * (1 + noise * (-1) ** p)) for p in range(1, n + 1)]


def test_elasticity(spark):
    rows = _elastic(spark, "steep", -2.0, 12, 0.05) + _elastic(spark, "flat", -0.5, 12) + _elastic(spark, "few", -2.0, 4)
    orders = spark.createDataFrame(rows, "sku_id string, unit_price double, quantity double")
    txn = spark.createDataFrame(_elastic(spark, "few", -3.0, 6), "sku_id string, total_unit_cost double, volume double")
    got = {r.sku_id: r for r in K.price_elasticity(txn, orders).collect()}
    assert got["steep"].elasticity == pytest.approx(-2.0, abs=0.1) and got["steep"].is_elastic
    assert got["steep"].optimal_markup == pytest.approx(-1 / (got["steep"].elasticity + 1), abs=1e-3)
    assert got["steep"].ci_low < got["steep"].elasticity < got["steep"].ci_high
    assert got["flat"].elasticity == pytest.approx(-0.5) and got["flat"].optimal_markup == 0.5
    assert got["few"].elasticity == pytest.approx(-3.0)  # too few orders: transactions are used


def test_elasticity_defaults_for_listed_skus(spark):
    orders = spark.createDataFrame([("a", -1.0, 1.0)] * 6, "sku_id string, unit_price double, quantity double")
    txn = spark.createDataFrame([], "sku_id string, total_unit_cost double, volume double")
    listed = spark.createDataFrame([("a",), ("b",)], "sku_id string")
    for row in K.price_elasticity(txn, orders, listed).collect():
        assert (row.elasticity, row.p_value, row.optimal_markup, row.ci_low, row.ci_high) == (-1.0, 1.0, 0.3, -2.0, 0.0)
        assert not row.is_elastic


def test_sensitivity_curve(spark):
    el = spark.createDataFrame([("a", -1.0), ("b", 0.0)], "sku_id string, elasticity double")
    txn = spark.createDataFrame([("a", 20.0, 10)], "sku_id string, total_unit_cost double, volume int")
    rows = K.price_sensitivity_curve(el, txn).collect()
    assert len(rows) == 40
    a = [r for r in rows if r.sku_id == "a"]
    assert a[0].price_multiplier == 0.5 and a[0].estimated_demand == 20.0 and a[0].estimated_revenue == 200.0
    b = [r for r in rows if r.sku_id == "b"]
    assert b[-1].price == 20.0 and b[-1].estimated_demand == 100.0


def test_cost_anomaly(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(days=i), "s", 10.0 if i < 20 else 30.0, 1) for i in range(21)]
    costs = spark.createDataFrame(rows, "transaction_date date, sku_id string, total_unit_cost double, volume int")
    got = R.cost_anomaly(costs).collect()
    assert len(got) == 1 and got[0].anomaly_status == "CRITICAL"
    mean = (20 * 10 + 30) / 21
    assert got[0].deviation_ratio == pytest.approx((30 - mean) / (mean * 0.1), abs=1e-5)


def test_reports_registry(spark, tmp_path):
    txn = spark.createDataFrame(
        [(D(2024, 1, 1), "s", "p", 5.0, 2, 1.0, 1.0, 3.0)],
        "transaction_date date, sku_id string, plant_id string, total_unit_cost double, volume int, "
        "raw_material_cost double, labor_cost double, overhead_cost double",
    )
    tables = {
        "fact_cost_transactions": txn,
        "dim_plant": spark.createDataFrame([("p",)], "plant_id string"),
        "dim_product": spark.createDataFrame([("s", "c", "Direct", 4.0)],
                                             "sku_id string, category string, cost_tier string, target_cost double"),
    }
    row = report(tables, "cost_variance").first()
    assert row.variance_status == "OVER_BUDGET" and row.period == D(2024, 1, 1)
    gap = report(tables, "should_cost_gap").first()
    assert gap.gap_pct == 0.25 and gap.largest_cost_element == "overhead"
    assert "HashAggregate" in explain_report(tables, "cost_variance")
    with pytest.raises(KeyError, match="available"):
        report(tables, "nope")
    done = []
    status = run_all_reports(tables, lambda name, df: done.append((name, df.count())))
    assert status["cost_variance"] == "ok" and status["supplier_performance"] != "ok"  # its tables are missing
    assert ("cost_anomaly", 0) in done


def test_outlier_query_lists_all_beyond_two(spark, monkeypatch):
    from spendwright.plans import load_queries

    # One cost at z = 2.1 and one at z = 5.0 among a flat rest.
    costs = [10.0] * 30 + [13.2, 17.0]
    rows = [(D(2024, 1, 1), i, 1, 1, c, 1) for i, c in enumerate(costs)]
    names = "transaction_date date, sku_id int, plant_id int, supplier_id int, total_unit_cost double, volume int"
    found = load_queries()["ocogs_outliers"].build({"fact_cost_transactions": spark.createDataFrame(rows, names)})
    scores = {r.total_unit_cost: r.z_score for r in found.collect()}
    assert set(scores) == {13.2, 17.0} and 2.0 < scores[13.2] < 2.5 < scores[17.0]


def test_recommend_spreads_scores_before_sorting(products, actions):
    best = K.recommend_actions(K.action_scores(products, actions), 3)
    plan = best._jdf.queryExecution().sparkPlan().toString()
    sorts = [i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line]
    made = [i for i, line in enumerate(plan.splitlines()) if "Generate" in line or "Expand" in line]
    spread = [i for i, line in enumerate(plan.splitlines()) if "RepartitionBy" in line or "REPARTITION_BY_COL" in line]
    # Plans list the last step first.
    assert spread and max(sorts) < spread[0] < min(made)
