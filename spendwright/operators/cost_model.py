"""Should-cost decomposition and make-versus-buy comparison for all SKUs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendwright.functions.grids import digits_of, explode_values, linspace, ratio
from spendwright.sources.session import sized

ELEMENTS = ("raw_material", "labor", "overhead", "logistics", "tariff")

# Fixed values of the should-cost model.
REFERENCE_LABOR_RATE = 15.0
DEFAULT_LABOR_RATE = 15.0
DEFAULT_OVERHEAD_RATE = 0.30
DEFAULT_COMMODITY_INDEX = 1.0
LOGISTICS_SHARE = 0.05
TARGET_MARKUP = 1.1

# Fixed values of the make-versus-buy model.
DEFAULT_WEIGHTS = {"cost": 0.35, "quality": 0.30, "lead_time": 0.20, "strategic": 0.15}
NO_QUOTE_MARKUP = 1.15
NO_QUOTE_LEAD_TIME = 14
DEFAULT_QUALITY = 0.92
STRATEGIC_MAKE = 0.7
STRATEGIC_BUY = 0.4
DECISION_BAND = 1.05


def commodity_latest(prices: DataFrame) -> DataFrame:
    """The latest price index of every commodity."""
    return prices.groupBy("commodity").agg(
        F.max_by("price_index", F.struct("price_date", "price_index")).alias("price_index")
    )


def should_cost_decompose(
    products: DataFrame,
    plants: DataFrame,
    prices: DataFrame,
    plant_id: object | None = None,
    digits: int | None = 4,
) -> DataFrame:
    """Cost elements, total and gap for every row of ``products``.

    ``products`` carries a ``plant_id`` column, or all rows are costed at the
    given plant. Unknown plants and commodities fall back to defaults.
    """
    if plant_id is not None:
        products = products.withColumn("plant_id", F.lit(plant_id))
    rates = plants.select("plant_id", "labor_rate_hourly", "overhead_rate")
    index = sized(commodity_latest(prices), "commodities").withColumnRenamed("commodity", "commodity_exposure")
    costed = products.join(rates, "plant_id", "left").join(index, "commodity_exposure", "left")

    base, sens = F.col("base_unit_cost"), F.col("commodity_sensitivity")
    labor_rate = F.coalesce("labor_rate_hourly", F.lit(DEFAULT_LABOR_RATE))
    overhead_rate = F.coalesce("overhead_rate", F.lit(DEFAULT_OVERHEAD_RATE))
    idx = F.coalesce("price_index", F.lit(DEFAULT_COMMODITY_INDEX))
    parts = {
        "raw_material": base * sens * (1.0 + (idx - 1.0) * sens),
        "labor": base * F.col("labor_intensity") * (labor_rate / REFERENCE_LABOR_RATE),
        "overhead": base * F.col("overhead_allocation") * (1.0 + overhead_rate),
        "logistics": base * LOGISTICS_SHARE,
        "tariff": base * F.col("tariff_exposure"),
    }
    costed = costed.select("sku_id", "plant_id", *_target(products), *[c.alias(f"_{n}") for n, c in parts.items()])
    costed = costed.withColumn("_total", sum((F.col(f"_{n}") for n in ELEMENTS[1:]), F.col("_raw_material")))
    actual = F.coalesce("_target", F.col("_total") * TARGET_MARKUP)
    gap = ratio(actual - F.col("_total"), F.col("_total"))
    return costed.select(
        "sku_id",
        "plant_id",
        *[digits_of(F.col(f"_{n}"), digits).alias(f"{n}_cost") for n in ELEMENTS],
        digits_of(F.col("_total"), digits).alias("total_should_cost"),
        digits_of(actual, digits).alias("current_actual_cost"),
        digits_of(gap, digits).alias("gap_pct"),
    )


def _target(products: DataFrame) -> list[Column]:
    has = "target_cost" in products.columns
    return [(F.col("target_cost") if has else F.lit(None).cast("double")).alias("_target")]


def largest_of(columns: Mapping[str, Column]) -> Column:
    """The name of the largest column; the first one wins a tie."""
    top = F.greatest(*columns.values())
    names = list(columns)
    choice = F.when(columns[names[0]] == top, F.lit(names[0]))
    for name in names[1:]:
        choice = choice.when(columns[name] == top, F.lit(name))
    return choice


def should_cost_benchmark(breakdowns: DataFrame) -> DataFrame:
    """Gap and largest element per costed product, largest gap first."""
    return breakdowns.select(
        "sku_id",
        "plant_id",
        F.col("total_should_cost").alias("should_cost"),
        F.col("current_actual_cost").alias("actual_cost"),
        "gap_pct",
        (F.col("current_actual_cost") - F.col("total_should_cost")).alias("gap_abs"),
        largest_of({n: F.col(f"{n}_cost") for n in ELEMENTS}).alias("largest_element"),
    ).orderBy(F.desc("gap_pct"))


def should_cost_gaps(breakdowns: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Products whose actual cost exceeds should-cost by more than a share."""
    return breakdowns.where(F.col("gap_pct") > threshold)


def best_supplier_quote(quotes: DataFrame) -> DataFrame:
    """The cheapest supplier per SKU among each supplier's latest quote.

    Quotes of one day are settled by the lower price, then the shorter lead
    time; suppliers of one price by the smaller id.
    """
    latest = quotes.groupBy("sku_id", "supplier_id").agg(
        F.max_by(
            F.struct("quoted_price", "lead_time_days"),
            F.struct("quote_date", -F.col("quoted_price"), -F.col("lead_time_days")),
        ).alias("q")
    )
    best = latest.groupBy("sku_id").agg(
        F.min(F.struct("q.quoted_price", "supplier_id", "q.lead_time_days")).alias("b")
    )
    return best.select(
        "sku_id",
        F.col("b.supplier_id").alias("best_supplier"),
        F.col("b.quoted_price").alias("quoted_price"),
        F.col("b.lead_time_days").alias("lead_time_days"),
    )


def quality_score(events: DataFrame, keys: list[str]) -> DataFrame:
    """One minus the mean defect rate per key."""
    return events.groupBy(*keys).agg((1.0 - F.avg("defect_rate")).alias("quality_score"))


def _rolled_quality(cells: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The quality score per key from summed cells."""
    sums = cells.groupBy(*keys).agg(F.sum("_d").alias("_d"), F.sum("_n").alias("_n"))
    return sums.select(*keys, (1.0 - F.try_divide("_d", "_n")).alias(name))


def make_vs_buy(
    pairs: DataFrame,
    products: DataFrame,
    plants: DataFrame,
    quotes: DataFrame,
    events: DataFrame | None = None,
    weights: Mapping[str, float] | None = None,
    digits: int | None = 4,
) -> DataFrame:
    """Compare making and buying for every (sku_id, plant_id) pair.

    Pairs with an unknown SKU or plant have no result.
    """
    w = dict(weights or DEFAULT_WEIGHTS)
    # Everything that depends on the SKU alone is settled per SKU first, so
    # pairs are joined twice only: with their SKU and with their plant quality.
    per_sku = products.select("sku_id", "base_unit_cost", "labor_intensity").join(
        best_supplier_quote(quotes), "sku_id", "left"
    )
    if events is None:
        per_sku = per_sku.select("*", *[F.lit(DEFAULT_QUALITY).alias(c) for c in ("_q_supplier", "_q_sku")])
    else:
        # One pass over the events; the three scores are rolled up from it.
        cells = events.groupBy("sku_id", "plant_id", "supplier_id").agg(
            F.sum("defect_rate").alias("_d"), F.count("defect_rate").alias("_n")
        )
        by_supplier = _rolled_quality(cells, ["sku_id", "supplier_id"], "_q_supplier")
        by_supplier = by_supplier.withColumnRenamed("supplier_id", "best_supplier")
        per_sku = per_sku.join(_rolled_quality(cells, ["sku_id"], "_q_sku"), "sku_id", "left").join(
            by_supplier, ["sku_id", "best_supplier"], "left"
        )
    known = (
        pairs.select("sku_id", "plant_id")
        .join(per_sku, "sku_id")
        .join(plants.select("plant_id", "labor_rate_hourly", "overhead_rate"), "plant_id")
    )
    if events is None:
        known = known.withColumn("_q_plant", F.lit(DEFAULT_QUALITY))
    else:
        known = known.join(_rolled_quality(cells, ["sku_id", "plant_id"], "_q_plant"), ["sku_id", "plant_id"], "left")

    base, labor_int = F.col("base_unit_cost"), F.col("labor_intensity")
    quoted = F.col("quoted_price").isNotNull()
    make = base * (
        1.0 + labor_int * (F.col("labor_rate_hourly") / REFERENCE_LABOR_RATE - 1.0) + F.col("overhead_rate")
    )
    costs = known.select(
        "sku_id",
        "plant_id",
        "best_supplier",
        make.alias("mk"),
        F.when(quoted, F.col("quoted_price")).otherwise(base * NO_QUOTE_MARKUP).alias("bk"),
        F.greatest(F.lit(1), (5 + labor_int * 10).cast("int")).alias("lead_time_make"),
        F.when(quoted, F.col("lead_time_days")).otherwise(NO_QUOTE_LEAD_TIME).cast("int").alias("lead_time_buy"),
        F.coalesce("_q_plant", F.lit(DEFAULT_QUALITY)).alias("qm"),
        F.coalesce(F.when(quoted, F.col("_q_supplier")).otherwise(F.col("_q_sku")), F.lit(DEFAULT_QUALITY)).alias("qb"),
        (base * F.col("overhead_rate") * 100.0).alias("fixed_cost"),
    )

    def against_best(value: str, other: str) -> Column:
        worst = F.greatest(F.col(value), F.col(other))
        return F.when(worst > 0, 1.0 - F.col(value) / worst).otherwise(0.5)

    def composite(cost: Column, quality: str, lead: Column, strategic: float) -> Column:
        return (
            w["cost"] * cost + w["quality"] * F.col(quality) + w["lead_time"] * lead + F.lit(w["strategic"] * strategic)
        )

    scored = costs.select(
        "*",
        composite(
            against_best("mk", "bk"), "qm", against_best("lead_time_make", "lead_time_buy"), STRATEGIC_MAKE
        ).alias("cm"),
        composite(
            against_best("bk", "mk"), "qb", against_best("lead_time_buy", "lead_time_make"), STRATEGIC_BUY
        ).alias("cb"),
    )
    mk, bk, cm, cb = F.col("mk"), F.col("bk"), F.col("cm"), F.col("cb")
    lowest = F.least(mk, bk)
    return scored.select(
        "sku_id",
        "plant_id",
        "best_supplier",
        digits_of(mk, digits).alias("make_cost"),
        digits_of(bk, digits).alias("buy_cost"),
        F.when(mk <= bk, "make").otherwise("buy").alias("cost_advantage"),
        digits_of(ratio(bk - mk, lowest), digits).alias("cost_delta_pct"),
        digits_of(F.col("qm"), digits and 3).alias("quality_score_make"),
        digits_of(F.col("qb"), digits and 3).alias("quality_score_buy"),
        "lead_time_make",
        "lead_time_buy",
        F.when(cm > cb * DECISION_BAND, "make")
        .when(cb > cm * DECISION_BAND, "buy")
        .otherwise("review")
        .alias("recommendation"),
        digits_of(cm, digits).alias("composite_score_make"),
        digits_of(cb, digits).alias("composite_score_buy"),
        F.when(mk != bk, (F.col("fixed_cost") / F.abs(bk - mk)).cast("bigint")).alias("breakeven_volume"),
    )


def make_vs_buy_sensitivity(
    comparison: DataFrame, cost_range: float = 0.20, steps: int = 5, digits: int | None = 4
) -> DataFrame:
    """Shock both costs over a grid; the bought cost moves half as much."""
    grid = explode_values(
        comparison.select("sku_id", "plant_id", F.col("make_cost").alias("_m"), F.col("buy_cost").alias("_b")),
        "_shock",
        linspace(-cost_range, cost_range, 2 * steps + 1),
    )
    shock = F.col("_shock")
    grid = grid.select(
        "sku_id",
        "plant_id",
        digits_of(shock, 3).alias("cost_change_pct"),
        (F.col("_m") * (1 + shock)).alias("_make"),
        (F.col("_b") * (1 + shock * 0.5)).alias("_buy"),
    )
    return grid.select(
        "sku_id",
        "plant_id",
        "cost_change_pct",
        digits_of(F.col("_make"), digits).alias("make_cost"),
        digits_of(F.col("_buy"), digits).alias("buy_cost"),
        F.when(F.col("_make") < F.col("_buy"), "make").otherwise("buy").alias("recommendation"),
    )
