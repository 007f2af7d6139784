"""The headline reports over the procurement star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendwright.functions.grids import ratio
from spendwright.operators.cost_model import ELEMENTS, largest_of

# Report thresholds.
OVER_BUDGET = 0.10
UNDER_BUDGET = -0.05
GAP_THRESHOLD = 0.10
WARNING_RATIO = 2.5
CRITICAL_RATIO = 3.0


def cost_variance(transactions: DataFrame, plants: DataFrame, products: DataFrame) -> DataFrame:
    """Monthly actual against target cost by plant and category.

    Transactions of unknown plants or products are left out. The plant check
    runs on the grouped rows: plant ids are few, and shuffling transactions by
    them would put whole plants into single tasks.
    """
    joined = transactions.join(products.select("sku_id", "category", "target_cost"), "sku_id")
    monthly = joined.groupBy(F.trunc("transaction_date", "month").alias("period"), "plant_id", "category").agg(
        F.avg("total_unit_cost").alias("avg_actual_cost"),
        F.avg("target_cost").alias("avg_target_cost"),
        F.sum("volume").alias("total_volume"),
        F.sum(F.col("total_unit_cost") * F.col("volume")).alias("total_actual"),
        F.sum(F.col("target_cost") * F.col("volume")).alias("total_budget"),
    )
    monthly = monthly.join(plants.select("plant_id"), "plant_id", "left_semi")
    actual, budget = F.col("total_actual"), F.col("total_budget")
    variance = F.when(budget == 0, F.lit(0.0)).otherwise((actual - budget) / budget)
    return (
        monthly.withColumn("variance_pct", variance)
        .withColumn(
            "variance_status",
            F.when((budget > 0) & (F.col("variance_pct") > OVER_BUDGET), "OVER_BUDGET")
            .when((budget > 0) & (F.col("variance_pct") < UNDER_BUDGET), "UNDER_BUDGET")
            .otherwise("ON_TARGET"),
        )
        .orderBy(F.desc("period"), F.desc("variance_pct"))
    )


def should_cost_gap(transactions: DataFrame, products: DataFrame, threshold: float = GAP_THRESHOLD) -> DataFrame:
    """SKUs whose average cost exceeds target by more than a share.

    Averages are taken per SKU before the product join, so the join sees one
    row per SKU and reuses the aggregation's partitioning.
    """
    per_sku = transactions.groupBy("sku_id").agg(
        F.avg("total_unit_cost").alias("avg_actual_cost"),
        F.count(F.lit(1)).alias("n_transactions"),
        F.avg("raw_material_cost").alias("raw_material"),
        F.avg("labor_cost").alias("labor"),
        F.avg("overhead_cost").alias("overhead"),
    )
    joined = per_sku.join(products.select("sku_id", "category", "cost_tier", "target_cost"), "sku_id")
    target = F.col("target_cost")
    return (
        joined.where(target > 0)
        .select(
            "sku_id",
            "category",
            "cost_tier",
            "target_cost",
            "avg_actual_cost",
            ((F.col("avg_actual_cost") - target) / target).alias("gap_pct"),
            (F.col("avg_actual_cost") - target).alias("gap_abs"),
            "n_transactions",
            largest_of({n: F.col(n) for n in ("raw_material", "labor", "overhead")}).alias("largest_cost_element"),
        )
        .where(F.col("gap_pct") > threshold)
        .orderBy(F.desc("gap_pct"))
    )


def supplier_performance(orders: DataFrame, suppliers: DataFrame, events: DataFrame) -> DataFrame:
    """Delivery, spend and quality per supplier, largest spend first."""

    def count_where(status: str) -> Column:
        return F.sum(F.when(F.col("delivery_status") == status, 1).otherwise(0))

    delivery = orders.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        count_where("delivered").alias("_delivered"),
        count_where("late").alias("_late"),
        F.avg("unit_price").alias("avg_unit_price"),
        F.sum("total_amount").alias("total_spend"),
        F.avg("actual_delivery_days").alias("avg_delivery_days"),
    )
    quality = events.groupBy("supplier_id").agg(
        F.avg("defect_rate").alias("_defect_rate"), F.sum("defects_found").alias("_defects")
    )
    joined = delivery.join(suppliers.select("supplier_id", "supplier_name", "country"), "supplier_id").join(
        quality, "supplier_id", "left"
    )

    def share(name: str) -> Column:
        return F.round(F.col(name).cast("double") / F.greatest("total_orders", F.lit(1)), 3)

    return joined.select(
        "supplier_id",
        "supplier_name",
        "country",
        "total_orders",
        "total_spend",
        share("_delivered").alias("delivery_rate"),
        share("_late").alias("late_rate"),
        "avg_unit_price",
        "avg_delivery_days",
        F.coalesce("_defect_rate", F.lit(0.0)).alias("avg_defect_rate"),
        F.coalesce("_defects", F.lit(0)).alias("total_defects"),
    ).orderBy(F.desc("total_spend"))


def cost_anomaly(
    costs: DataFrame,
    date: str = "transaction_date",
    value: str = "total_unit_cost",
    volume: str = "volume",
    window_rows: int = 30,
    warning: float = WARNING_RATIO,
    critical: float = CRITICAL_RATIO,
    ratio_digits: int = 6,
) -> DataFrame:
    """SKU days whose average cost leaves the band around the recent mean.

    The window runs over day rows, so a SKU has at most one row per calendar
    day in it however many transactions it has.
    """
    daily = costs.groupBy(F.col(date).alias("date"), "sku_id").agg(
        F.avg(value).alias("avg_daily_cost"), F.sum(volume).alias("daily_volume")
    )
    recent = Window.partitionBy("sku_id").orderBy("date").rowsBetween(-(window_rows - 1), 0)
    rolled = daily.withColumn("rolling_mean", F.avg("avg_daily_cost").over(recent))
    mean = F.col("rolling_mean")
    deviation = F.abs(F.col("avg_daily_cost") - mean) / F.greatest(mean * 0.1, F.lit(0.01))
    return (
        rolled.where(mean > 0)
        .withColumn("deviation_ratio", F.round(deviation, ratio_digits))
        .where(F.col("deviation_ratio") > warning)
        .select(
            "date",
            "sku_id",
            "avg_daily_cost",
            "rolling_mean",
            "deviation_ratio",
            F.when(F.col("deviation_ratio") > critical, "CRITICAL").otherwise("WARNING").alias("anomaly_status"),
        )
        .orderBy(F.desc("date"), F.desc("deviation_ratio"))
    )


def variance_heatmap(transactions: DataFrame, products: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Variance share as one row per plant and one column per category."""
    joined = transactions.join(products.select("sku_id", "category", "target_cost"), "sku_id")
    actual = F.sum(F.col("total_unit_cost") * F.col("volume"))
    budget = F.sum(F.col("target_cost") * F.col("volume"))
    cells = joined.groupBy("plant_id", "category").agg(actual.alias("a"), budget.alias("b"))
    cells = cells.select("plant_id", "category", ratio(F.col("a") - F.col("b"), F.col("b")).alias("v"))
    return cells.groupBy("plant_id").pivot("category", list(categories)).agg(F.first("v"))


def rolling_zscore(
    transactions: DataFrame, window_rows: int = 30, threshold: float = 2.5, std_floor: float = 0.01
) -> DataFrame:
    """Daily average cost scored against the preceding days.

    The global window runs over one row per calendar day.
    """
    daily = transactions.groupBy(F.col("transaction_date").alias("date")).agg(
        F.avg("total_unit_cost").alias("avg_cost")
    )
    order = Window.partitionBy(F.lit(0)).orderBy("date")
    before = order.rowsBetween(-window_rows, -1)
    scored = daily.select(
        "date",
        "avg_cost",
        F.row_number().over(order).alias("_i"),
        F.avg("avg_cost").over(before).alias("_m"),
        F.stddev_pop("avg_cost").over(before).alias("_s"),
    )
    z = F.when(
        F.col("_i") > window_rows, (F.col("avg_cost") - F.col("_m")) / F.greatest("_s", F.lit(std_floor))
    ).otherwise(0.0)
    return scored.select("date", "avg_cost", z.alias("z_score"), (F.abs(z) > threshold).alias("is_anomaly"))


def kpi_overview(
    transactions: DataFrame,
    products: DataFrame,
    plants: DataFrame,
    suppliers: DataFrame,
    orders: DataFrame,
    events: DataFrame,
    actions: DataFrame,
    breakdowns: DataFrame,
) -> DataFrame:
    """Headline figures in one row, each from its own one-row aggregate."""
    per_sku = transactions.groupBy("sku_id").agg(
        F.sum(F.col("total_unit_cost") * F.col("volume")).alias("_a"), F.sum("volume").alias("_v")
    )
    budget = per_sku.join(products.select("sku_id", "target_cost"), "sku_id").agg(
        F.sum("_a").alias("a"), F.sum(F.col("target_cost") * F.col("_v")).alias("b")
    )
    status = F.col("delivery_status")
    on_time = orders.agg(
        F.try_divide(
            F.sum(F.when(status == "delivered", 1.0).otherwise(0.0)),
            F.sum(F.when(status.isin("delivered", "late"), 1.0).otherwise(0.0)),
        )
    )
    quality = events.agg(1.0 - F.try_divide(F.sum("defects_found").cast("double"), F.sum("batch_size")))
    savings = actions.where(F.col("status") == "completed").agg(F.avg("actual_savings_pct"))
    return products.agg(F.count(F.lit(1)).alias("n_skus")).select(
        budget.select(ratio(F.col("a") - F.col("b"), F.col("b"))).scalar().alias("cost_variance_pct"),
        breakdowns.agg(F.avg("gap_pct")).scalar().alias("should_cost_gap_pct"),
        savings.scalar().alias("savings_realized_pct"),
        on_time.scalar().alias("supplier_on_time_pct"),
        quality.scalar().alias("quality_yield_pct"),
        "n_skus",
        plants.agg(F.count(F.lit(1))).scalar().alias("n_plants"),
        suppliers.agg(F.count(F.lit(1))).scalar().alias("n_suppliers"),
    )


def cost_element_breakdown(breakdowns: DataFrame, transactions: DataFrame) -> DataFrame:
    """Average should-cost and actual cost per element with the gap.

    Transactions carry no tariff, so its actual side is null.
    """
    should = breakdowns.agg(*[F.avg(f"{n}_cost").alias(n) for n in ELEMENTS])
    actual = transactions.agg(*[F.avg(f"{n}_cost").alias(n) for n in ELEMENTS if n != "tariff"])
    should = should.unpivot([], list(ELEMENTS), "element", "should_cost")
    actual = actual.unpivot([], [n for n in ELEMENTS if n != "tariff"], "element", "actual_cost")
    return should.join(actual, "element", "left").withColumn("gap", F.col("actual_cost") - F.col("should_cost"))


def commodity_monthly_index(prices: DataFrame) -> DataFrame:
    """Average price index per month and commodity."""
    return prices.groupBy(F.trunc("price_date", "month").alias("month"), "commodity").agg(
        F.avg("price_index").alias("price_index")
    )
