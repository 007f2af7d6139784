"""Queries of the reports, the cost models and the table catalog."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendwright.operators import cost_model as M
from spendwright.operators import cost_tracking as K
from spendwright.operators import reports as R
from spendwright.plans.registry import query
from spendwright.plans.reports import explain_report, report, run_all_reports
from spendwright.sources import catalog, files
from spendwright.sources.session import new_path
from spendwright.sources.views import BASE_TABLES, VIEWS, Tables

STAR = [v for v in VIEWS if v.startswith(("dim_", "fact_"))]

# ---------------------------------------------------------------- catalog


def _counts_sql(names) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in names)


@query("row_counts", "table_name row_count:i", sql=_counts_sql(BASE_TABLES))
def _(t: Tables):
    return catalog.row_counts({n: t[n] for n in BASE_TABLES})


@query("table_summary", "table_name row_count:i", " ".join(STAR), _counts_sql(STAR))
def _(t: Tables):
    return catalog.row_counts({n: t[n] for n in STAR})


_INFO_TABLES = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


@query(
    "table_info",
    "table_name position:i column_name non_null:i",
    sql=" UNION ALL ".join(
        f"SELECT '{n}' AS table_name, {i} AS position, '{c}' AS column_name, count({c}) AS non_null FROM {n}"
        for n, cols in _INFO_TABLES.items()
        for i, c in enumerate(cols.split())
    ),
)
def _(t: Tables):
    return catalog.columns_frame({n: t[n] for n in _INFO_TABLES})


_FRACTIONS = set("c_acctbal s_acctbal p_retailprice o_totalprice l_quantity l_extendedprice l_discount l_tax value".split())
_TIMES = {"ts", "o_orderdate", "l_shipdate"}
_LISTS = {"embedding"}


def _framed_sql(text: str) -> str:
    return f"coalesce(strlen({text}) || ':' || {text}, 'n')"


def _fraction_sql(c: str) -> str:
    size, unit = f"abs({c}::DOUBLE)", "4503599627370496::DOUBLE"
    first = f"(({size} - floor({size})) * {unit})"
    parts = " || '_' || ".join(f"floor({x})::BIGINT" for x in (size, first, f"({first} - floor({first})) * {unit}"))
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || {parts})"


def _column_sql(c: str) -> str:
    if c in _LISTS:
        joined = f"list_transform({c}, lambda e: {_framed_sql(_fraction_sql('e'))})"
        return _framed_sql(f"CASE WHEN {c} IS NOT NULL THEN array_to_string({joined}, '') END")
    if c in _FRACTIONS:
        return _framed_sql(_fraction_sql(c))
    return _framed_sql(f"CAST(epoch_us({c}) AS VARCHAR)" if c in _TIMES else f"CAST({c} AS VARCHAR)")


def _fingerprint_sql(name: str, columns: str) -> str:
    row = " || ".join(_column_sql(c) for c in columns.split())
    sums = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(4))
    return (f"SELECT '{name}' AS table_name, count(*) AS row_count, concat_ws('-', {sums}) AS hash_sum, "
            f"bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS hash_xor FROM (SELECT sha256({row}) AS h FROM {name})")


@query("table_fingerprint", "table_name row_count:i hash_sum hash_xor:i",
       sql=" UNION ALL ".join(_fingerprint_sql(n, c) for n, c in _INFO_TABLES.items()))
def _(t: Tables):
    return catalog.table_fingerprint({n: t[n] for n in BASE_TABLES})


@query("register_tables", "plant_id:i n:i", "dim_plant fact_cost_transactions",
       "SELECT p.plant_id, count(*) AS n FROM fact_cost_transactions f JOIN dim_plant p ON f.plant_id = p.plant_id "
       "GROUP BY p.plant_id")
def _(t: Tables):
    catalog.register_tables(t.spark, {n: t[n] for n in ("dim_plant", "fact_cost_transactions")})
    return t.spark.sql(
        "SELECT p.plant_id, count(*) AS n FROM fact_cost_transactions f JOIN dim_plant p "
        "ON f.plant_id = p.plant_id GROUP BY p.plant_id"
    )


@query(
    "csv_source",
    "s_suppkey:i s_name s_nationkey:i s_acctbal:2",
    sql="SELECT * FROM supplier",
)
def _(t: Tables):
    """A table through CSV files and back, read under a fallback name."""
    folder = new_path(t.spark, "csv")
    suppliers = t["supplier"]
    files.write_csv(suppliers, f"{folder}/suppliers.csv")
    return files.read_csv(t.spark, folder, ["dim_supplier", "suppliers"], suppliers.schema)


@query(
    "audit_json",
    "user action outcome entries:i total_ms:2",
    "audit_log",
    """SELECT CAST(user_name AS VARCHAR) AS "user", action, outcome, count(*) AS entries, sum(duration_ms) AS total_ms
FROM audit_log GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    """Audit records appended as JSON lines in two runs and read back."""
    path = new_path(t.spark, "audit-json")
    log = t["audit_log"].withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    log = log.withColumn("user", F.col("user_name").cast("string")).drop("user_name")
    files.append_audit(log.where("outcome = 'success'"), path)
    files.append_audit(log.where("outcome <> 'success'"), path)
    return files.read_audit(t.spark, path).groupBy("user", "action", "outcome").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("duration_ms").alias("total_ms")
    )


# ---------------------------------------------------------------- reports

_VARIANCE_SQL = """
WITH monthly AS (
  SELECT date_trunc('month', f.transaction_date) AS period, f.plant_id, p.category,
    avg(f.total_unit_cost) AS avg_actual_cost, avg(p.target_cost) AS avg_target_cost, sum(f.volume) AS total_volume,
    sum(f.total_unit_cost * f.volume) AS total_actual, sum(p.target_cost * f.volume) AS total_budget
  FROM fact_cost_transactions f JOIN dim_plant l ON f.plant_id = l.plant_id JOIN dim_product p ON f.sku_id = p.sku_id
  GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN total_budget = 0 THEN 0 ELSE (total_actual - total_budget) / total_budget END AS variance_pct
  FROM monthly)
SELECT *, CASE WHEN total_budget > 0 AND variance_pct > 0.10 THEN 'OVER_BUDGET'
  WHEN total_budget > 0 AND variance_pct < -0.05 THEN 'UNDER_BUDGET' ELSE 'ON_TARGET' END AS variance_status FROM v"""

_VARIANCE_COLUMNS = (
    "period:d plant_id:i category avg_actual_cost:4 avg_target_cost:4 total_volume:i total_actual:1 total_budget:1 "
    "variance_pct:6 variance_status"
)


@query("cost_variance", _VARIANCE_COLUMNS, "dim_plant dim_product fact_cost_transactions", _VARIANCE_SQL)
def _(t: Tables):
    return report(t, "cost_variance")


@query(
    "should_cost_gap",
    "sku_id:i category cost_tier target_cost:4 avg_actual_cost:4 gap_pct:6 gap_abs:4 n_transactions:i "
    "largest_cost_element",
    "dim_product fact_cost_transactions",
    """
WITH s AS (SELECT f.sku_id, p.category, p.cost_tier, p.target_cost, avg(f.total_unit_cost) AS avg_actual_cost,
    count(*) AS n_transactions, avg(raw_material_cost) AS r, avg(labor_cost) AS l, avg(overhead_cost) AS o
  FROM fact_cost_transactions f JOIN dim_product p ON f.sku_id = p.sku_id GROUP BY 1, 2, 3, 4)
SELECT *, (avg_actual_cost - target_cost) / target_cost AS gap_pct, avg_actual_cost - target_cost AS gap_abs,
  CASE WHEN r >= l AND r >= o THEN 'raw_material' WHEN l >= r AND l >= o THEN 'labor' ELSE 'overhead' END
    AS largest_cost_element
FROM s WHERE target_cost > 0 AND (avg_actual_cost - target_cost) / target_cost > 0.10""",
)
def _(t: Tables):
    return report(t, "should_cost_gap")


@query(
    "supplier_performance",
    "supplier_id:i supplier_name country total_orders:i total_spend:2 delivery_rate:3 late_rate:3 avg_unit_price:4 "
    "avg_delivery_days:4 avg_defect_rate:6 total_defects:i",
    "dim_supplier fact_purchase_orders fact_quality_events",
    """
WITH m AS (SELECT o.supplier_id, s.supplier_name, s.country, count(*) AS total_orders,
    sum(CASE WHEN delivery_status = 'delivered' THEN 1 ELSE 0 END) AS d,
    sum(CASE WHEN delivery_status = 'late' THEN 1 ELSE 0 END) AS l, avg(unit_price) AS avg_unit_price,
    sum(total_amount) AS total_spend, avg(actual_delivery_days) AS avg_delivery_days
  FROM fact_purchase_orders o JOIN dim_supplier s ON o.supplier_id = s.supplier_id GROUP BY 1, 2, 3),
q AS (SELECT supplier_id, avg(defect_rate) AS a, sum(defects_found) AS f FROM fact_quality_events GROUP BY 1)
SELECT m.*, round(CAST(d AS DOUBLE) / greatest(total_orders, 1), 3) AS delivery_rate,
  round(CAST(l AS DOUBLE) / greatest(total_orders, 1), 3) AS late_rate, coalesce(a, 0) AS avg_defect_rate,
  coalesce(f, 0) AS total_defects FROM m LEFT JOIN q ON m.supplier_id = q.supplier_id""",
)
def _(t: Tables):
    return report(t, "supplier_performance")


@query(
    "cost_anomaly",
    "date:d sku_id:i avg_daily_cost:4 rolling_mean:4 deviation_ratio:4 anomaly_status",
    "fact_purchase_orders",
    """
WITH d AS (SELECT order_date AS date, sku_id, avg(unit_price) AS avg_daily_cost FROM fact_purchase_orders GROUP BY 1, 2),
r AS (SELECT *, avg(avg_daily_cost) OVER (PARTITION BY sku_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
  AS rolling_mean FROM d),
x AS (SELECT *, round(abs(avg_daily_cost - rolling_mean) / greatest(rolling_mean * 0.1, 0.01), 6) AS deviation_ratio
  FROM r WHERE rolling_mean > 0)
SELECT *, CASE WHEN deviation_ratio > 3.0 THEN 'CRITICAL' ELSE 'WARNING' END AS anomaly_status FROM x
WHERE deviation_ratio > 2.5""",
)
def _(t: Tables):
    return R.cost_anomaly(t["fact_purchase_orders"], date="order_date", value="unit_price", volume="quantity")


_REPORT_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS report, count(*) AS row_count FROM {source}"
    for name, source in (("cost_variance", "r1"), ("should_cost_gap", "r2"), ("supplier_performance", "r3"))
)

_REPORT_CTES = """WITH r1 AS (SELECT DISTINCT date_trunc('month', transaction_date) AS m, f.plant_id, category
  FROM fact_cost_transactions f JOIN dim_plant l ON f.plant_id = l.plant_id JOIN dim_product p ON f.sku_id = p.sku_id),
r2 AS (SELECT f.sku_id FROM fact_cost_transactions f JOIN dim_product p ON f.sku_id = p.sku_id
  GROUP BY f.sku_id, target_cost HAVING (avg(total_unit_cost) - target_cost) / target_cost > 0.10),
r3 AS (SELECT DISTINCT o.supplier_id FROM fact_purchase_orders o JOIN dim_supplier s ON o.supplier_id = s.supplier_id)"""


@query(
    "run_all_reports",
    "report status row_count:i",
    "dim_plant dim_product dim_supplier fact_cost_transactions fact_purchase_orders",
    _REPORT_CTES + f""",
d AS (SELECT transaction_date AS dd, sku_id, avg(total_unit_cost) AS a FROM fact_cost_transactions GROUP BY 1, 2),
w AS (SELECT a, avg(a) OVER (PARTITION BY sku_id ORDER BY dd ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m FROM d),
r4 AS (SELECT * FROM w WHERE m > 0 AND round(abs(a - m) / greatest(m * 0.1, 0.01), 6) > 2.5)
SELECT *, 'ok' AS status FROM ({_REPORT_ROWS} UNION ALL SELECT 'cost_anomaly', count(*) FROM r4)""",
)
def _(t: Tables):
    """Every report written to its own table, then counted."""
    paths: dict[str, str] = {}

    def sink(name, df):
        paths[name] = new_path(t.spark, name)
        df.write.parquet(paths[name])

    status = run_all_reports(t, sink)
    rows = [
        t.spark.read.parquet(path)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("report"), F.lit(status[name]).alias("status"), "row_count")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query(
    "explain_report",
    "report prunes_columns:b aggregates:b row_count:i",
    "dim_plant dim_product dim_supplier fact_cost_transactions fact_purchase_orders",
    _REPORT_CTES + f" SELECT *, true AS prunes_columns, true AS aggregates FROM ({_REPORT_ROWS})",
)
def _(t: Tables):
    """What the plan text of three reports shows, next to their row counts."""
    rows = []
    for name in ("cost_variance", "should_cost_gap", "supplier_performance"):
        text = explain_report(t, name)
        scan = re.search(r"lineitem\.parquet.*?ReadSchema: (\S+)", text, re.S).group(1)
        facts = {
            "report": name,
            "prunes_columns": scan.count(":") < len(t["lineitem"].columns),
            "aggregates": "HashAggregate" in text,
        }
        counted = report(t, name).agg(F.count(F.lit(1)).alias("row_count"))
        rows.append(counted.select(*[F.lit(v).alias(k) for k, v in facts.items()], "row_count"))
    return reduce(DataFrame.unionByName, rows)


CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "variance_heatmap",
    "plant_id:i " + " ".join(f"{c}:6" for c in CATEGORIES),
    "dim_product fact_cost_transactions",
    "WITH c AS (SELECT plant_id, category, (sum(total_unit_cost * volume) - sum(target_cost * volume)) / "
    "sum(target_cost * volume) AS v FROM fact_cost_transactions f JOIN dim_product p ON f.sku_id = p.sku_id "
    "GROUP BY 1, 2) SELECT plant_id, "
    + ", ".join(f"max(CASE WHEN category = '{c}' THEN v END) AS {c}" for c in CATEGORIES)
    + " FROM c GROUP BY plant_id",
)
def _(t: Tables):
    return R.variance_heatmap(t["fact_cost_transactions"], t["dim_product"], CATEGORIES)


@query(
    "rolling_zscore",
    "date:d avg_cost:4 z_score:4 is_anomaly:b",
    "fact_cost_transactions",
    """
WITH d AS (SELECT transaction_date AS date, avg(total_unit_cost) AS avg_cost FROM fact_cost_transactions GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY date) AS i,
  avg(avg_cost) OVER (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS m,
  stddev_pop(avg_cost) OVER (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS s FROM d),
z AS (SELECT date, avg_cost, CASE WHEN i > 30 THEN (avg_cost - m) / greatest(s, 0.01) ELSE 0 END AS z_score FROM w)
SELECT *, abs(z_score) > 2.5 AS is_anomaly FROM z""",
)
def _(t: Tables):
    return R.rolling_zscore(t["fact_cost_transactions"])


_PAIR_COSTS = """
pairs AS (SELECT DISTINCT sku_id, plant_id FROM fact_cost_transactions),
idx AS (SELECT commodity, arg_max(price_index, price_date) AS price_index FROM fact_commodity_prices GROUP BY 1),
raw AS (SELECT p.sku_id, q.plant_id,
    base_unit_cost * commodity_sensitivity * (1.0 + (coalesce(price_index, 1.0) - 1.0) * commodity_sensitivity)
      AS raw_material_cost,
    base_unit_cost * labor_intensity * (coalesce(labor_rate_hourly, 15.0) / 15.0) AS labor_cost,
    base_unit_cost * overhead_allocation * (1.0 + coalesce(overhead_rate, 0.30)) AS overhead_cost,
    base_unit_cost * 0.05 AS logistics_cost, base_unit_cost * tariff_exposure AS tariff_cost,
    target_cost AS current_actual_cost
  FROM pairs q JOIN dim_product p ON p.sku_id = q.sku_id LEFT JOIN dim_plant l ON l.plant_id = q.plant_id
  LEFT JOIN idx ON commodity = commodity_exposure),
tot AS (SELECT *, raw_material_cost + labor_cost + overhead_cost + logistics_cost + tariff_cost AS total_should_cost
  FROM raw),
bd AS (SELECT *, CASE WHEN total_should_cost > 0 THEN (current_actual_cost - total_should_cost) / total_should_cost
  ELSE 0 END AS gap_pct FROM tot)"""
_PAIR_VIEWS = "dim_product dim_plant fact_cost_transactions fact_commodity_prices"
_BREAKDOWN_COLUMNS = (
    "sku_id:i plant_id:i raw_material_cost:4 labor_cost:4 overhead_cost:4 logistics_cost:4 tariff_cost:4 "
    "total_should_cost:4 current_actual_cost:4 gap_pct:6"
)


def _pairs(t: Tables):
    """Every (SKU, plant) pair that has transactions, with product traits."""
    pairs = t["fact_cost_transactions"].select("sku_id", "plant_id").distinct()
    return pairs.join(t["dim_product"], "sku_id")


def _breakdowns(t: Tables):
    return M.should_cost_decompose(_pairs(t), t["dim_plant"], t["fact_commodity_prices"], digits=None)


@query(
    "kpi_overview",
    "cost_variance_pct:6 should_cost_gap_pct:6 savings_realized_pct:6 supplier_on_time_pct:6 quality_yield_pct:6 "
    "n_skus:i n_plants:i n_suppliers:i",
    _PAIR_VIEWS + " dim_supplier fact_purchase_orders fact_quality_events fact_cost_reduction_actions",
    "WITH " + _PAIR_COSTS.lstrip() + """
SELECT (SELECT (sum(total_unit_cost * volume) - sum(target_cost * volume)) / sum(target_cost * volume)
    FROM fact_cost_transactions f JOIN dim_product p ON f.sku_id = p.sku_id) AS cost_variance_pct,
  (SELECT avg(gap_pct) FROM bd) AS should_cost_gap_pct,
  (SELECT avg(actual_savings_pct) FROM fact_cost_reduction_actions WHERE status = 'completed') AS savings_realized_pct,
  (SELECT count(*) FILTER (delivery_status = 'delivered') / count(*) FILTER (delivery_status IN ('delivered', 'late'))
    FROM fact_purchase_orders) AS supplier_on_time_pct,
  (SELECT 1.0 - CAST(sum(defects_found) AS DOUBLE) / sum(batch_size) FROM fact_quality_events) AS quality_yield_pct,
  (SELECT count(*) FROM dim_product) AS n_skus, (SELECT count(*) FROM dim_plant) AS n_plants,
  (SELECT count(*) FROM dim_supplier) AS n_suppliers""",
)
def _(t: Tables):
    return R.kpi_overview(
        t["fact_cost_transactions"],
        t["dim_product"],
        t["dim_plant"],
        t["dim_supplier"],
        t["fact_purchase_orders"],
        t["fact_quality_events"],
        t["fact_cost_reduction_actions"],
        _breakdowns(t),
    )


@query(
    "cost_element_breakdown",
    "element should_cost:4 actual_cost:4 gap:4",
    _PAIR_VIEWS,
    "WITH " + _PAIR_COSTS.lstrip() + ", r AS (" + " UNION ALL ".join(
        f"SELECT '{e}' AS element, (SELECT avg({e}_cost) FROM bd) AS should_cost, "
        + (f"(SELECT avg({e}_cost) FROM fact_cost_transactions)" if e != "tariff" else "CAST(NULL AS DOUBLE)")
        + " AS actual_cost"
        for e in M.ELEMENTS
    ) + ") SELECT *, actual_cost - should_cost AS gap FROM r",
)
def _(t: Tables):
    return R.cost_element_breakdown(_breakdowns(t), t["fact_cost_transactions"])


@query(
    "commodity_monthly_index",
    "month:d commodity price_index:6",
    "fact_commodity_prices",
    "SELECT date_trunc('month', price_date) AS month, commodity, avg(price_index) AS price_index "
    "FROM fact_commodity_prices GROUP BY 1, 2",
)
def _(t: Tables):
    return R.commodity_monthly_index(t["fact_commodity_prices"])


# ---------------------------------------------------------------- should-cost


@query(
    "commodity_latest",
    "commodity price_index:6",
    "fact_commodity_prices",
    "SELECT commodity, arg_max(price_index, price_date) AS price_index FROM fact_commodity_prices GROUP BY 1",
)
def _(t: Tables):
    return M.commodity_latest(t["fact_commodity_prices"])


@query(
    "should_cost_decompose", _BREAKDOWN_COLUMNS, _PAIR_VIEWS, "WITH " + _PAIR_COSTS.lstrip() + " SELECT * FROM bd"
)
def _(t: Tables):
    return _breakdowns(t)


@query(
    "should_cost_batch",
    _BREAKDOWN_COLUMNS,
    _PAIR_VIEWS,
    "WITH " + _PAIR_COSTS.lstrip().replace(
        "SELECT DISTINCT sku_id, plant_id FROM fact_cost_transactions", "SELECT sku_id, 7 AS plant_id FROM dim_product"
    ) + " SELECT * FROM bd",
)
def _(t: Tables):
    return M.should_cost_decompose(
        t["dim_product"], t["dim_plant"], t["fact_commodity_prices"], plant_id=7, digits=None
    )


_BENCHMARK_SQL = """, bench AS (SELECT sku_id, plant_id, total_should_cost AS should_cost,
  current_actual_cost AS actual_cost, gap_pct, current_actual_cost - total_should_cost AS gap_abs,
  greatest(raw_material_cost, labor_cost, overhead_cost, logistics_cost, tariff_cost) AS top,
  CASE WHEN raw_material_cost = top THEN 'raw_material' WHEN labor_cost = top THEN 'labor'
    WHEN overhead_cost = top THEN 'overhead' WHEN logistics_cost = top THEN 'logistics' ELSE 'tariff' END
    AS largest_element FROM bd)"""


@query(
    "should_cost_benchmark",
    "sku_id:i plant_id:i should_cost:4 actual_cost:4 gap_pct:6 gap_abs:4 largest_element",
    _PAIR_VIEWS,
    "WITH " + _PAIR_COSTS.lstrip() + _BENCHMARK_SQL + " SELECT * FROM bench",
)
def _(t: Tables):
    return M.should_cost_benchmark(_breakdowns(t))


@query(
    "should_cost_gaps",
    _BREAKDOWN_COLUMNS,
    _PAIR_VIEWS,
    "WITH " + _PAIR_COSTS.lstrip() + " SELECT * FROM bd WHERE gap_pct > 0.10",
)
def _(t: Tables):
    return M.should_cost_gaps(_breakdowns(t))


# ---------------------------------------------------------------- make or buy

_QUOTE_SQL = """
lq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku_id, supplier_id
    ORDER BY quote_date DESC, quoted_price, lead_time_days) AS i FROM fact_supplier_quotes) WHERE i = 1),
bq AS (SELECT sku_id, supplier_id AS best_supplier, quoted_price, lead_time_days FROM (SELECT *, row_number() OVER (
    PARTITION BY sku_id ORDER BY quoted_price, supplier_id) AS j FROM lq) WHERE j = 1)"""

_MVB_SQL = _QUOTE_SQL + """,
prs AS (SELECT DISTINCT sku_id, plant_id FROM fact_cost_transactions),
qp AS (SELECT sku_id, plant_id, 1.0 - avg(defect_rate) AS q FROM fact_quality_events GROUP BY 1, 2),
qs AS (SELECT sku_id, supplier_id, 1.0 - avg(defect_rate) AS q FROM fact_quality_events GROUP BY 1, 2),
qa AS (SELECT sku_id, 1.0 - avg(defect_rate) AS q FROM fact_quality_events GROUP BY 1),
c AS (SELECT r.sku_id, r.plant_id, best_supplier,
    base_unit_cost * (1.0 + labor_intensity * (labor_rate_hourly / 15.0 - 1.0) + overhead_rate) AS mk,
    coalesce(quoted_price, base_unit_cost * 1.15) AS bk,
    greatest(1, CAST(trunc(5 + labor_intensity * 10) AS INT)) AS lm, coalesce(lead_time_days, 14) AS lb,
    coalesce(qp.q, 0.92) AS qm,
    coalesce(CASE WHEN quoted_price IS NOT NULL THEN qs.q ELSE qa.q END, 0.92) AS qb,
    base_unit_cost * overhead_rate * 100.0 AS fixed
  FROM prs r JOIN dim_product p ON r.sku_id = p.sku_id JOIN dim_plant l ON r.plant_id = l.plant_id
  LEFT JOIN bq ON bq.sku_id = r.sku_id LEFT JOIN qp ON qp.sku_id = r.sku_id AND qp.plant_id = r.plant_id
  LEFT JOIN qs ON qs.sku_id = r.sku_id AND qs.supplier_id = best_supplier LEFT JOIN qa ON qa.sku_id = r.sku_id),
s AS (SELECT *,
    0.35 * (CASE WHEN greatest(mk, bk) > 0 THEN 1 - mk / greatest(mk, bk) ELSE 0.5 END) + 0.30 * qm
      + 0.20 * (1 - CAST(lm AS DOUBLE) / greatest(lm, lb)) + 0.15 * 0.7 AS cm,
    0.35 * (CASE WHEN greatest(mk, bk) > 0 THEN 1 - bk / greatest(mk, bk) ELSE 0.5 END) + 0.30 * qb
      + 0.20 * (1 - CAST(lb AS DOUBLE) / greatest(lm, lb)) + 0.15 * 0.4 AS cb FROM c),
mvb AS (SELECT sku_id, plant_id, best_supplier, mk AS make_cost, bk AS buy_cost,
  CASE WHEN mk <= bk THEN 'make' ELSE 'buy' END AS cost_advantage,
  CASE WHEN least(mk, bk) > 0 THEN (bk - mk) / least(mk, bk) ELSE 0 END AS cost_delta_pct,
  qm AS quality_score_make, qb AS quality_score_buy, lm AS lead_time_make, lb AS lead_time_buy,
  CASE WHEN cm > cb * 1.05 THEN 'make' WHEN cb > cm * 1.05 THEN 'buy' ELSE 'review' END AS recommendation,
  cm AS composite_score_make, cb AS composite_score_buy,
  CASE WHEN mk <> bk THEN CAST(trunc(fixed / abs(bk - mk)) AS BIGINT) END AS breakeven_volume FROM s)"""
_MVB_VIEWS = "dim_product dim_plant fact_cost_transactions fact_supplier_quotes fact_quality_events"


def _make_vs_buy(t: Tables):
    pairs = t["fact_cost_transactions"].select("sku_id", "plant_id").distinct()
    return M.make_vs_buy(
        pairs, t["dim_product"], t["dim_plant"], t["fact_supplier_quotes"], t["fact_quality_events"], digits=None
    )


@query(
    "best_supplier_quote",
    "sku_id:i best_supplier:i quoted_price:4 lead_time_days:i",
    "fact_supplier_quotes",
    "WITH " + _QUOTE_SQL.lstrip() + " SELECT * FROM bq",
)
def _(t: Tables):
    return M.best_supplier_quote(t["fact_supplier_quotes"])


@query(
    "quality_score",
    "sku_id:i supplier_id:i quality_score:6",
    "fact_quality_events",
    "SELECT sku_id, supplier_id, 1.0 - avg(defect_rate) AS quality_score FROM fact_quality_events GROUP BY 1, 2",
)
def _(t: Tables):
    return M.quality_score(t["fact_quality_events"], ["sku_id", "supplier_id"])


@query(
    "make_vs_buy",
    "sku_id:i plant_id:i best_supplier:i make_cost:4 buy_cost:4 cost_advantage cost_delta_pct:6 quality_score_make:4 "
    "quality_score_buy:4 lead_time_make:i lead_time_buy:i recommendation composite_score_make:6 "
    "composite_score_buy:6 breakeven_volume:0",
    _MVB_VIEWS,
    "WITH " + _MVB_SQL.lstrip() + " SELECT * FROM mvb",
)
def _(t: Tables):
    return _make_vs_buy(t)


@query(
    "make_vs_buy_sensitivity",
    "sku_id:i plant_id:i cost_change_pct:3 make_cost:4 buy_cost:4 recommendation",
    _MVB_VIEWS,
    "WITH " + _MVB_SQL.lstrip() + """,
g AS (SELECT sku_id, plant_id, s AS cost_change_pct, make_cost * (1 + s) AS make_cost,
  buy_cost * (1 + s * 0.5) AS buy_cost
  FROM mvb, (SELECT CASE WHEN i = 10 THEN 0.2 ELSE CAST(-0.2 AS DOUBLE) + CAST(0.04 AS DOUBLE) * i END AS s
    FROM range(0, 11) t(i)))
SELECT *, CASE WHEN make_cost < buy_cost THEN 'make' ELSE 'buy' END AS recommendation FROM g""",
)
def _(t: Tables):
    return M.make_vs_buy_sensitivity(_make_vs_buy(t), digits=None)


# ---------------------------------------------------------------- tracking

_PERIOD = (dt.date(1994, 1, 1), dt.date(1996, 12, 31))


@query(
    "ocogs_variance",
    "period_start:d period_end:d total_actual:0 total_budget:0 variance_pct:6 favorable:b",
    "dim_product fact_cost_transactions",
    """
WITH s AS (SELECT sum(total_unit_cost * volume) AS a, sum(coalesce(target_cost, total_unit_cost) * volume) AS b
  FROM fact_cost_transactions f LEFT JOIN dim_product p ON f.sku_id = p.sku_id
  WHERE transaction_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31')
SELECT DATE '1994-01-01' AS period_start, DATE '1996-12-31' AS period_end, coalesce(a, 0) AS total_actual,
  coalesce(b, 0) AS total_budget, CASE WHEN b > 0 THEN (a - b) / b ELSE 0 END AS variance_pct,
  CASE WHEN b > 0 THEN (a - b) / b ELSE 0 END <= 0 AS favorable FROM s""",
)
def _(t: Tables):
    return K.ocogs_variance(t["fact_cost_transactions"], t["dim_product"], *_PERIOD, digits=None)


@query(
    "ocogs_variance_by_category",
    "category total_actual:0 total_budget:0 variance_pct:6",
    "dim_product fact_cost_transactions",
    """
WITH s AS (SELECT category, sum(total_unit_cost * volume) AS total_actual,
    sum(coalesce(target_cost, total_unit_cost) * volume) AS total_budget
  FROM fact_cost_transactions f LEFT JOIN dim_product p ON f.sku_id = p.sku_id WHERE category IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN total_budget > 0 THEN (total_actual - total_budget) / total_budget ELSE 0 END AS variance_pct
FROM s""",
)
def _(t: Tables):
    return K.ocogs_variance_by_category(t["fact_cost_transactions"], t["dim_product"], digits=None)


@query(
    "ocogs_trend",
    "period:d avg_unit_cost:4 total_cost:0 volume:i cost_change_pct:6",
    "fact_cost_transactions",
    """
WITH f AS (SELECT * FROM fact_cost_transactions WHERE transaction_date >=
    (SELECT max(transaction_date) - INTERVAL 12 MONTH FROM fact_cost_transactions)),
m AS (SELECT last_day(transaction_date) AS period, avg(total_unit_cost) AS avg_unit_cost,
  sum(total_unit_cost * volume) AS total_cost, sum(volume) AS volume FROM f GROUP BY 1),
spine AS (SELECT last_day(CAST(d AS DATE)) AS period FROM (SELECT unnest(generate_series(date_trunc('month', min(period)),
  date_trunc('month', max(period)), INTERVAL 1 MONTH)) AS d FROM m)),
j AS (SELECT spine.period, avg_unit_cost, coalesce(total_cost, 0) AS total_cost, coalesce(volume, 0) AS volume
  FROM spine LEFT JOIN m ON m.period = spine.period),
k AS (SELECT *, last_value(avg_unit_cost IGNORE NULLS) OVER (ORDER BY period) AS filled FROM j)
SELECT *, filled / lag(filled) OVER (ORDER BY period) - 1 AS cost_change_pct FROM k""",
)
def _(t: Tables):
    return K.ocogs_trend(t["fact_cost_transactions"])


@query(
    "ocogs_outliers",
    "transaction_date:d sku_id:i plant_id:i supplier_id:i total_unit_cost:4 volume:i z_score:5",
    "fact_cost_transactions",
    """
WITH m AS (SELECT avg(total_unit_cost) AS m, stddev_samp(total_unit_cost) AS s FROM fact_cost_transactions)
SELECT f.*, (total_unit_cost - m) / s AS z_score FROM fact_cost_transactions f, m
WHERE abs((total_unit_cost - m) / s) > 2.0""",
)
def _(t: Tables):
    return K.ocogs_outliers(t["fact_cost_transactions"], z_threshold=2.0)


# ---------------------------------------------------------------- savings

_SCORES_SQL = """
h AS (SELECT action_type, avg(actual_savings_pct) AS e FROM fact_cost_reduction_actions
  WHERE status = 'completed' AND actual_savings_pct IS NOT NULL GROUP BY 1),
a AS (SELECT * FROM (VALUES
  (0, 'supplier_switch', 0.08, 0.7, 0.4), (1, 'material_substitution', 0.06, 0.6, 0.3),
  (2, 'process_optimization', 0.05, 0.8, 0.5), (3, 'automation', 0.12, 0.5, 0.3),
  (4, 'volume_consolidation', 0.04, 0.7, 0.5), (5, 'nearshoring', 0.07, 0.4, 0.2),
  (6, 'design_change', 0.10, 0.5, 0.3), (7, 'negotiate_contract', 0.03, 0.8, 0.6))
  AS v(action_order, action_type, prior, known, fresh)),
sc AS (SELECT sku_id, a.action_type, action_order,
  CAST(coalesce(e, prior) AS DOUBLE) * CASE action_order WHEN 0 THEN 1 + commodity_sensitivity
    WHEN 1 THEN 1 + commodity_sensitivity * 0.5 WHEN 2 THEN 1 + labor_intensity WHEN 3 THEN labor_intensity
    WHEN 5 THEN 1 + tariff_exposure * 2 WHEN 6 THEN 1 + overhead_allocation * 0.5 ELSE 1 END AS estimated_savings_pct,
  CASE WHEN e IS NOT NULL THEN known ELSE fresh END AS confidence, coalesce(e, 0) AS historical_avg,
  CASE action_order
    WHEN 0 THEN 'High commodity sensitivity (' || pc || '%) suggests supplier diversification'
    WHEN 1 THEN 'Commodity exposure (' || pc || '%) makes material alternatives viable'
    WHEN 2 THEN 'Labor intensity (' || pl || '%) indicates process optimization potential'
    WHEN 3 THEN 'Labor-intensive (' || pl || '%) — automation could reduce recurring costs'
    WHEN 4 THEN 'Consolidating volumes across plants for better pricing'
    WHEN 5 THEN 'Tariff exposure (' || pt || '%) may justify nearshoring'
    WHEN 6 THEN 'Design-for-cost can reduce overhead allocation (' || po || '%)'
    ELSE 'Contract renegotiation for volume/term improvements' END AS rationale
  FROM (SELECT *, CAST(round(commodity_sensitivity * 100) AS INT) AS pc, CAST(round(labor_intensity * 100) AS INT) AS pl,
    CAST(round(tariff_exposure * 100) AS INT) AS pt, CAST(round(overhead_allocation * 100) AS INT) AS po
    FROM dim_product) p, a LEFT JOIN h ON h.action_type = a.action_type)"""
_ACTION_VIEWS = "dim_product fact_cost_reduction_actions"


def _scores(t: Tables):
    return K.action_scores(t["dim_product"], t["fact_cost_reduction_actions"])


@query(
    "action_effectiveness",
    "action_type historical_avg:6",
    "fact_cost_reduction_actions",
    "SELECT action_type, avg(actual_savings_pct) AS historical_avg FROM fact_cost_reduction_actions "
    "WHERE status = 'completed' AND actual_savings_pct IS NOT NULL GROUP BY 1",
)
def _(t: Tables):
    return K.action_effectiveness(t["fact_cost_reduction_actions"])


@query(
    "action_scores",
    "sku_id:i action_type estimated_savings_pct:6 confidence:2 historical_avg:6 rationale",
    _ACTION_VIEWS,
    "WITH " + _SCORES_SQL.lstrip() + " SELECT * FROM sc",
)
def _(t: Tables):
    return _scores(t)


@query(
    "recommend_actions",
    "sku_id:i rank:i action_type estimated_savings_pct:6 confidence:2 rationale",
    _ACTION_VIEWS,
    "WITH " + _SCORES_SQL.lstrip() + ", r AS (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY "
    "estimated_savings_pct DESC, action_order) AS rank FROM sc) SELECT * FROM r WHERE rank <= 3",
)
def _(t: Tables):
    return K.recommend_actions(_scores(t))


_REQUESTS_SQL = """SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN -l_partkey ELSE l_partkey END AS sku_id,
  CASE l_returnflag WHEN 'R' THEN 'nearshoring' WHEN 'A' THEN 'automation' ELSE 'no_such_action' END AS action_type
  FROM lineitem"""


@query(
    "estimate_savings",
    "sku_id:i action_type estimated_savings_pct:6 confidence:2 historical_avg:6",
    _ACTION_VIEWS,
    "WITH " + _SCORES_SQL.lstrip() + f", q AS ({_REQUESTS_SQL}) SELECT q.sku_id, q.action_type, "
    "coalesce(estimated_savings_pct, 0) AS estimated_savings_pct, coalesce(confidence, 0) AS confidence, "
    "coalesce(historical_avg, 0) AS historical_avg FROM q LEFT JOIN sc ON q.sku_id = sc.sku_id "
    "AND q.action_type = sc.action_type",
)
def _(t: Tables):
    return K.estimate_savings(t.sql(_REQUESTS_SQL), _scores(t), digits=None)


@query(
    "realization_tracking",
    "action_type count:i avg_projected:6 avg_actual:6 realization_rate:6",
    "fact_cost_reduction_actions",
    """SELECT action_type, count(action_id) AS count, avg(projected_savings_pct) AS avg_projected,
  avg(actual_savings_pct) AS avg_actual, CASE WHEN avg(projected_savings_pct) > 0
  THEN avg(actual_savings_pct) / avg(projected_savings_pct) ELSE 0 END AS realization_rate
FROM fact_cost_reduction_actions WHERE status = 'completed' GROUP BY 1""",
)
def _(t: Tables):
    return K.realization_tracking(t["fact_cost_reduction_actions"], digits=None)


# ---------------------------------------------------------------- elasticity


def _fit_sql(source: str, price: str, quantity: str) -> str:
    usable = f"{price} > 0 AND {quantity} > 0"
    x, y = f"CASE WHEN {usable} THEN ln({price}) END", f"CASE WHEN {usable} THEN ln({quantity}) END"
    return f"""SELECT sku_id, count(*) AS rows, regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2,
    regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
  FROM (SELECT sku_id, {x} AS x, {y} AS y FROM {source}) GROUP BY 1"""


# Student's t tail as its finite trigonometric series in cos^2 = nu / (nu + t^2).
_T_TAIL_SQL = """CASE WHEN nu IS NULL THEN 1.0 WHEN nu % 2 = 1 THEN
    1 - 2 / pi() * (atan(t / sqrt(nu)) + CASE WHEN nu >= 3 THEN sqrt(1 - c2) * sqrt(c2) * list_sum(list_transform(
      range(0, CAST((nu - 1) // 2 AS BIGINT)), lambda k: list_aggregate([1.0::DOUBLE] || list_transform(
        range(1, k + 1), lambda j: 2.0::DOUBLE * j / (2 * j + 1) * c2), 'product'))) ELSE 0 END)
  ELSE 1 - sqrt(1 - c2) * list_sum(list_transform(range(0, CAST(nu // 2 AS BIGINT)), lambda k: list_aggregate(
      [1.0::DOUBLE] || list_transform(range(1, k + 1), lambda j: (2.0::DOUBLE * j - 1) / (2 * j) * c2), 'product')))
  END"""


def _elasticity_sql(po_source: str) -> str:
    return f"""
po AS ({_fit_sql(po_source, "unit_price", "quantity")}),
tx AS ({_fit_sql("fact_cost_transactions", "total_unit_cost", "volume")}),
b AS (SELECT coalesce(po.sku_id, tx.sku_id) AS sku_id, CASE WHEN po.rows >= 5 THEN 1 WHEN tx.rows >= 5 THEN 2 END AS src,
  po.n AS n1, po.slope AS s1, po.r2 AS r1, po.sxx AS xx1, po.syy AS yy1, po.sxy AS xy1,
  tx.n AS n2, tx.slope AS s2, tx.r2 AS r2, tx.sxx AS xx2, tx.syy AS yy2, tx.sxy AS xy2
  FROM po FULL OUTER JOIN tx ON po.sku_id = tx.sku_id),
f AS (SELECT sku_id, CASE src WHEN 1 THEN n1 WHEN 2 THEN n2 END AS n, CASE src WHEN 1 THEN s1 WHEN 2 THEN s2 END AS slope,
  CASE src WHEN 1 THEN r1 WHEN 2 THEN r2 END AS r2, CASE src WHEN 1 THEN xx1 WHEN 2 THEN xx2 END AS sxx,
  CASE src WHEN 1 THEN yy1 WHEN 2 THEN yy2 END AS syy, CASE src WHEN 1 THEN xy1 WHEN 2 THEN xy2 END AS sxy FROM b),
u AS (SELECT *, coalesce(n, 0) >= 5 AS ok, CASE WHEN coalesce(n, 0) >= 5 THEN n - 2 END AS nu,
  sqrt(greatest(syy - slope * sxy, 0) / (n - 2) / sxx) AS se FROM f),
w AS (SELECT *, CASE WHEN ok THEN abs(slope / se) END AS t,
  CASE WHEN ok THEN nu / (nu + (slope / se) * (slope / se)) END AS c2 FROM u),
th AS (SELECT DISTINCT nu, 0.0::DOUBLE AS low, 4.0::DOUBLE AS high, 0 AS halved FROM u WHERE ok
  UNION ALL SELECT nu, CASE WHEN tail > 0.05 THEN t ELSE low END, CASE WHEN tail > 0.05 THEN high ELSE t END, halved + 1
  FROM (SELECT *, {_T_TAIL_SQL} AS tail FROM (SELECT *, nu / (nu + t * t) AS c2
  FROM (SELECT *, (low + high) / 2 AS t FROM th WHERE halved < 48)))),
tq AS (SELECT nu, low AS t975 FROM th WHERE halved = 48),
el AS (SELECT sku_id, CASE WHEN ok THEN slope ELSE -1.0 END AS elasticity, CASE WHEN ok THEN abs(slope) > 1 ELSE false END
    AS is_elastic, CASE WHEN ok THEN r2 ELSE 0 END AS r_squared, {_T_TAIL_SQL} AS p_value,
  CASE WHEN NOT ok THEN 0.30 WHEN slope < -1 THEN least(greatest(-1 / (slope + 1), 0.05), 2.0) ELSE 0.50 END
    AS optimal_markup, CASE WHEN ok THEN slope - t975 * se ELSE {K.DEFAULT_ELASTICITY["ci_low"]} END AS ci_low,
  CASE WHEN ok THEN slope + t975 * se ELSE {K.DEFAULT_ELASTICITY["ci_high"]} END AS ci_high FROM w LEFT JOIN tq USING (nu))"""


_ELASTICITY_VIEWS = "fact_purchase_orders fact_cost_transactions"
_ELASTICITY_COLUMNS = "sku_id:i elasticity:4 is_elastic:b r_squared:4 p_value:4 optimal_markup:4 ci_low:4 ci_high:4"


@query(
    "price_elasticity",
    _ELASTICITY_COLUMNS,
    _ELASTICITY_VIEWS,
    "WITH RECURSIVE " + _elasticity_sql("fact_purchase_orders").lstrip() + " SELECT * FROM el",
)
def _(t: Tables):
    return K.price_elasticity(t["fact_cost_transactions"], t["fact_purchase_orders"], digits=None)


_LATE_ORDERS = "SELECT * FROM fact_purchase_orders WHERE delivery_status = 'late'"


@query(
    "price_elasticity_by_source",
    _ELASTICITY_COLUMNS,
    _ELASTICITY_VIEWS,
    "WITH RECURSIVE lo AS (" + _LATE_ORDERS + ")," + _elasticity_sql("lo") + " SELECT * FROM el",
)
def _(t: Tables):
    late = t["fact_purchase_orders"].where(F.col("delivery_status") == "late")
    return K.price_elasticity(t["fact_cost_transactions"], late, digits=None)


@query(
    "price_elasticity_batch",
    _ELASTICITY_COLUMNS,
    _ELASTICITY_VIEWS + " fact_quality_events",
    "WITH RECURSIVE " + _elasticity_sql("fact_purchase_orders").lstrip() + ", l AS (SELECT DISTINCT CASE WHEN defect_rate > 0.09 "
    "THEN -sku_id ELSE sku_id END AS sku_id FROM fact_quality_events) SELECT l.sku_id, coalesce(elasticity, -1.0) AS "
    "elasticity, coalesce(is_elastic, false) AS is_elastic, coalesce(r_squared, 0) AS r_squared, "
    "coalesce(p_value, 1) AS p_value, coalesce(optimal_markup, 0.30) AS optimal_markup, "
    f"CASE WHEN el.sku_id IS NULL THEN {K.DEFAULT_ELASTICITY['ci_low']} ELSE ci_low END AS ci_low, "
    f"CASE WHEN el.sku_id IS NULL THEN {K.DEFAULT_ELASTICITY['ci_high']} ELSE ci_high END AS ci_high "
    "FROM l LEFT JOIN el ON el.sku_id = l.sku_id",
)
def _(t: Tables):
    """The SKUs with quality events; some ids are unknown and get defaults."""
    listed = t["fact_quality_events"].select(
        F.when(F.col("defect_rate") > 0.09, -F.col("sku_id")).otherwise(F.col("sku_id")).alias("sku_id")
    )
    return K.price_elasticity(t["fact_cost_transactions"], t["fact_purchase_orders"], listed, digits=None)


@query(
    "price_sensitivity_curve",
    "sku_id:i price_multiplier:3 price:2 estimated_demand:2 estimated_revenue:2 estimated_profit:2",
    _ELASTICITY_VIEWS,
    "WITH RECURSIVE " + _elasticity_sql("fact_purchase_orders").lstrip() + """,
m AS (SELECT sku_id, avg(total_unit_cost) AS p, avg(volume) AS q FROM fact_cost_transactions GROUP BY 1),
c AS (SELECT el.sku_id, elasticity, coalesce(p, 10.0) AS p, coalesce(q, 100.0) AS q FROM el LEFT JOIN m ON m.sku_id = el.sku_id),
g AS (SELECT *, CASE WHEN i = 19 THEN 2.0 ELSE 0.5 + CAST(1.5 AS DOUBLE) / 19 * i END AS x FROM c, range(0, 20) t(i)),
d AS (SELECT *, p * x AS price, q * pow(x, elasticity) AS dem FROM g)
SELECT sku_id, x AS price_multiplier, price, greatest(dem, 0) AS estimated_demand,
  greatest(price * dem, 0) AS estimated_revenue, price * dem - p * dem AS estimated_profit FROM d""",
)
def _(t: Tables):
    fitted = K.price_elasticity(t["fact_cost_transactions"], t["fact_purchase_orders"], digits=None)
    return K.price_sensitivity_curve(fitted, t["fact_cost_transactions"], digits=None)
