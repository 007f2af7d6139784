"""Declared contracts of the star schema and of the result tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """Type and row checks of one column."""

    dtype: str
    nullable: bool = False
    unique: bool = False
    prefix: str | None = None
    isin: tuple[str, ...] | None = None
    gt: float | None = None
    ge: float | None = None
    between: tuple[float, float] | None = None


Contract = dict[str, Rule]


def text(**checks) -> Rule:
    return Rule("string", **checks)


def choice(values: Sequence[str]) -> Rule:
    return Rule("string", isin=tuple(values))


def number(**checks) -> Rule:
    return Rule("double", **checks)


def whole(**checks) -> Rule:
    return Rule("bigint", **checks)


DAY = Rule("date")
SHARE = number(between=(0, 1))
POSITIVE = number(gt=0)
SKU, SUPPLIER, PLANT = text(prefix="SKU_"), text(prefix="SUP_"), text(prefix="PLT_")

# The allowed words of the schema.
CATEGORIES = ("RawMaterials", "Components", "Packaging", "Labor", "Overhead")
COST_TIERS = ("Direct", "Indirect")
COMMODITIES = ("Steel", "Copper", "Resin", "Aluminum", "Silicon")
SUPPLIERS = ("SupplierAlpha", "SupplierBeta", "SupplierGamma", "SupplierDelta", "SupplierEpsilon")
SUPPLIER_COUNTRIES = ("CN", "TW", "DE", "US", "IN")
PLANT_COUNTRIES = ("CN", "TW", "DE", "US", "MX", "IN", "JP")
ACTION_TYPES = (
    "supplier_switch",
    "design_change",
    "volume_consolidation",
    "process_optimization",
    "material_substitution",
    "nearshoring",
    "automation",
    "negotiate_contract",
)
ACTION_STATUS = ("proposed", "approved", "in_progress", "completed", "cancelled")
DELIVERY_STATUS = ("pending", "shipped", "delivered", "late")
DISPOSITIONS = ("accepted", "rework", "scrap", "return_to_supplier")

CONTRACTS: dict[str, Contract] = {
    "dim_product": {
        "sku_id": text(prefix="SKU_", unique=True),
        "product_name": text(),
        "category": choice(CATEGORIES),
        "cost_tier": choice(COST_TIERS),
        "subcategory": text(),
        "primary_supplier": choice(SUPPLIERS),
        "base_unit_cost": POSITIVE,
        "target_cost": POSITIVE,
        "commodity_exposure": choice(COMMODITIES),
        "commodity_sensitivity": SHARE,
        "labor_intensity": SHARE,
        "overhead_allocation": SHARE,
        "moq": whole(gt=0),
        "tariff_exposure": number(between=(0, 0.5)),
    },
    "dim_supplier": {
        "supplier_id": text(prefix="SUP_", unique=True),
        "supplier_name": choice(SUPPLIERS),
        "country": choice(SUPPLIER_COUNTRIES),
        "quality_score": SHARE,
        "on_time_delivery_pct": SHARE,
        "lead_time_days": whole(gt=0),
        "price_premium": number(between=(-0.2, 0.5)),
    },
    "dim_plant": {
        "plant_id": text(prefix="PLT_", unique=True),
        "country": choice(PLANT_COUNTRIES),
        "region": text(),
        "lat": number(between=(-90, 90)),
        "lon": number(between=(-180, 180)),
        "labor_rate_hourly": POSITIVE,
        "overhead_rate": SHARE,
        "capacity_utilization": SHARE,
    },
    "fact_cost_transactions": {
        "transaction_id": text(prefix="TXN_"),
        "transaction_date": DAY,
        "sku_id": SKU,
        "plant_id": PLANT,
        "supplier_id": SUPPLIER,
        "raw_material_cost": number(ge=0),
        "labor_cost": number(ge=0),
        "overhead_cost": number(ge=0),
        "logistics_cost": number(ge=0),
        "total_unit_cost": POSITIVE,
        "volume": whole(gt=0),
    },
    "fact_supplier_quotes": {
        "quote_id": text(prefix="QUO_"),
        "quote_date": DAY,
        "supplier_id": SUPPLIER,
        "sku_id": SKU,
        "quoted_price": POSITIVE,
        "lead_time_days": whole(gt=0),
        "moq": whole(gt=0),
        "valid_until": DAY,
    },
    "fact_cost_reduction_actions": {
        "action_id": text(prefix="CRA_"),
        "action_date": DAY,
        "sku_id": SKU,
        "action_type": choice(ACTION_TYPES),
        "projected_savings_pct": SHARE,
        "actual_savings_pct": number(between=(-0.5, 1), nullable=True),
        "status": choice(ACTION_STATUS),
    },
    "fact_commodity_prices": {
        "price_date": DAY,
        "commodity": choice(COMMODITIES),
        "price_index": POSITIVE,
        "pct_change": number(),
        "volatility_30d": number(ge=0),
    },
    "fact_purchase_orders": {
        "po_id": text(prefix="PO_"),
        "order_date": DAY,
        "sku_id": SKU,
        "supplier_id": SUPPLIER,
        "plant_id": PLANT,
        "unit_price": POSITIVE,
        "quantity": whole(gt=0),
        "total_amount": POSITIVE,
        "delivery_status": choice(DELIVERY_STATUS),
        "actual_delivery_days": whole(ge=0, nullable=True),
    },
    "fact_quality_events": {
        "event_id": text(prefix="QE_"),
        "event_date": DAY,
        "sku_id": SKU,
        "supplier_id": SUPPLIER,
        "plant_id": PLANT,
        "defect_rate": SHARE,
        "batch_size": whole(gt=0),
        "defects_found": whole(ge=0),
        "disposition": choice(DISPOSITIONS),
    },
    "should_cost_result": {
        "sku_id": text(),
        "should_cost": POSITIVE,
        "actual_cost": POSITIVE,
        "gap_pct": number(),
        "gap_abs": number(),
        "largest_element": text(),
    },
    "cost_variance_result": {
        "period": DAY,
        "avg_unit_cost": POSITIVE,
        "total_cost": number(ge=0),
        "volume": whole(ge=0),
        "cost_change_pct": number(nullable=True),
    },
    "make_vs_buy_result": {
        "cost_change_pct": number(),
        "make_cost": POSITIVE,
        "buy_cost": POSITIVE,
        "recommendation": choice(("make", "buy")),
    },
}


def spark_schema(contract: Contract) -> T.StructType:
    """The declared columns as a Spark schema for readers."""
    types = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "date": T.DateType()}
    return T.StructType([T.StructField(name, types[rule.dtype], True) for name, rule in contract.items()])
