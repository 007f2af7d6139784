"""Queries of data quality and fairness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendwright.operators import fairness as Y
from spendwright.operators import quality as Q
from spendwright.plans import resampling_sql as R
from spendwright.plans.registry import query
from spendwright.sources.contracts import CONTRACTS, Rule, choice, number, text, whole
from spendwright.sources.views import Tables

# ---------------------------------------------------------------- contracts

ORDER_STATUS = ("F", "O")
CONTRACT = {
    "o_orderkey": Rule("bigint", unique=True),
    "o_custkey": whole(gt=0),
    "o_orderstatus": choice(ORDER_STATUS),
    "o_totalprice": number(between=(1000, 400000)),
    "o_orderdate": Rule("date"),
    "o_orderpriority": text(prefix="1"),
}
ITEM_CONTRACT = {
    "l_orderkey": Rule("bigint", unique=True),
    "l_quantity": number(ge=1, gt=2),
    "l_discount": number(between=(0, 0.09)),
    "l_returnflag": choice(("A", "N")),
    "l_shipdate": Rule("date"),
}


def _fact(table: str, column: str, check: str, condition: str) -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", '{check}' AS \"check\", "
        f"count(*) FILTER ({condition}) AS failures FROM {table}"
    )


_CONTRACT_SQL = " UNION ALL ".join(
    [_fact("orders", c, check, cond) for c, check, cond in [
        ("o_orderkey", "type", "false"),
        ("o_orderkey", "not_null", "o_orderkey IS NULL"),
        ("o_custkey", "type", "false"),
        ("o_custkey", "not_null", "o_custkey IS NULL"),
        ("o_custkey", "gt", "NOT o_custkey > 0"),
        ("o_orderstatus", "type", "false"),
        ("o_orderstatus", "not_null", "o_orderstatus IS NULL"),
        ("o_orderstatus", "isin", "o_orderstatus NOT IN ('F', 'O')"),
        ("o_totalprice", "type", "false"),
        ("o_totalprice", "not_null", "o_totalprice IS NULL"),
        ("o_totalprice", "between", "NOT o_totalprice BETWEEN 1000 AND 400000"),
        ("o_orderdate", "type", "false"),
        ("o_orderdate", "not_null", "o_orderdate IS NULL"),
        ("o_orderpriority", "type", "false"),
        ("o_orderpriority", "not_null", "o_orderpriority IS NULL"),
        ("o_orderpriority", "prefix", "NOT starts_with(o_orderpriority, '1')"),
    ]]
    + [_fact("lineitem", c, check, cond) for c, check, cond in [
        ("l_orderkey", "type", "false"),
        ("l_orderkey", "not_null", "l_orderkey IS NULL"),
        ("l_quantity", "type", "false"),
        ("l_quantity", "not_null", "l_quantity IS NULL"),
        ("l_quantity", "gt", "NOT l_quantity > 2"),
        ("l_quantity", "ge", "NOT l_quantity >= 1"),
        ("l_discount", "type", "false"),
        ("l_discount", "not_null", "l_discount IS NULL"),
        ("l_discount", "between", "NOT l_discount BETWEEN 0 AND 0.09"),
        ("l_returnflag", "type", "false"),
        ("l_returnflag", "not_null", "l_returnflag IS NULL"),
        ("l_returnflag", "isin", "l_returnflag NOT IN ('A', 'N')"),
        ("l_shipdate", "type", "false"),
        ("l_shipdate", "not_null", "l_shipdate IS NULL"),
    ]]
    + [
        "SELECT 'orders', 'o_orderkey', 'unique', count(*) - count(DISTINCT o_orderkey) FROM orders",
        "SELECT 'lineitem', 'l_orderkey', 'unique', count(*) - count(DISTINCT l_orderkey) FROM lineitem",
    ]
)


def _contracts(t: Tables):
    return Q.contract_check(t["orders"], CONTRACT, "orders").unionByName(
        Q.contract_check(t["lineitem"], ITEM_CONTRACT, "lineitem")
    )


@query("contract_check", "table column check failures:i", sql=_CONTRACT_SQL)
def _(t: Tables):
    return _contracts(t)


@query(
    "contract_verdict",
    "table valid:b failures:i",
    sql=f'SELECT "table", sum(failures) = 0 AS valid, sum(failures) AS failures FROM ({_CONTRACT_SQL}) GROUP BY 1',
)
def _(t: Tables):
    tables = {"orders": t["orders"], "lineitem": t["lineitem"]}
    return Q.validate_all(tables, {"orders": CONTRACT, "lineitem": ITEM_CONTRACT})


# The declared contracts of the star schema over its views, whose ids are numbers and which lack some columns.
_STAR = ("dim_product", "dim_supplier", "dim_plant", "fact_cost_transactions", "fact_supplier_quotes",
         "fact_cost_reduction_actions", "fact_commodity_prices", "fact_purchase_orders", "fact_quality_events")
_ABSENT = {
    "dim_product": "primary_supplier",
    "dim_supplier": "quality_score on_time_delivery_pct lead_time_days price_premium",
    "dim_plant": "region lat lon capacity_utilization",
    "fact_cost_transactions": "transaction_id",
    "fact_supplier_quotes": "quote_id moq valid_until",
    "fact_cost_reduction_actions": "sku_id",
    "fact_commodity_prices": "pct_change volatility_30d",
    "fact_purchase_orders": "plant_id",
    "fact_quality_events": "event_id disposition",
}


def _rule_sql(name: str, rule: Rule) -> list[tuple[str, str]]:
    """(check, number of failures) of one declared column."""
    value = f"TRY_CAST({name} AS {'VARCHAR' if rule.dtype == 'string' else rule.dtype})"
    broken = [("type", f"{name} IS NOT NULL AND {value} IS NULL")]
    if not rule.nullable:
        broken.append(("not_null", f"{name} IS NULL" + (f" OR isnan({value})" if rule.dtype == "double" else "")))
    if rule.prefix is not None:
        broken.append(("prefix", f"NOT starts_with({value}, '{rule.prefix}')"))
    if rule.isin is not None:
        broken.append(("isin", f"{value} NOT IN ({', '.join(repr(v) for v in rule.isin)})"))
    if rule.gt is not None:
        broken.append(("gt", f"NOT {value} > {rule.gt}"))
    if rule.ge is not None:
        broken.append(("ge", f"NOT {value} >= {rule.ge}"))
    if rule.between is not None:
        broken.append(("between", f"NOT {value} BETWEEN {rule.between[0]} AND {rule.between[1]}"))
    counts = [(check, f"count(*) FILTER ({condition})") for check, condition in broken]
    return counts + ([("unique", f"count(*) - count(DISTINCT {name}) - coalesce(max(CAST({name} IS NULL AS INT)), 0)")] if rule.unique else [])


def _star_sql() -> str:
    parts = []
    for table in _STAR:
        absent = _ABSENT[table].split()
        facts = [
            f"{{'column': '{name}', 'check': '{check}', 'failures': {count}}}"
            for name, rule in CONTRACTS[table].items()
            for check, count in ([("present", "count(*)")] if name in absent else _rule_sql(name, rule))
        ]
        parts.append(f"SELECT '{table}' AS \"table\", unnest([{', '.join(facts)}], recursive := true) FROM {table}")
    return "\nUNION ALL ".join(parts)


@query("star_contracts", "table column check failures:i", " ".join(_STAR), _star_sql())
def _(t: Tables):
    return reduce(DataFrame.unionByName, [Q.contract_check(t[n], CONTRACTS[n], n) for n in _STAR])


@query(
    "star_contract_verdict",
    "table valid:b failures:i",
    " ".join(_STAR),
    f'SELECT "table", sum(failures) = 0 AS valid, sum(failures) AS failures FROM ({_star_sql()}) GROUP BY 1',
)
def _(t: Tables):
    return Q.validate_all({n: t[n] for n in _STAR}, CONTRACTS)


# ---------------------------------------------------------------- expectations

_SHORT = {
    "expect_row_count_between": "expect_table_row_count_to_be_between",
    "expect_not_null": "expect_column_values_to_not_be_null",
    "expect_between": "expect_column_values_to_be_between",
    "expect_in_set": "expect_column_values_to_be_in_set",
    "expect_unique": "expect_column_values_to_be_unique",
    "expect_match_regex": "expect_column_values_to_match_regex",
    "expect_mean_between": "expect_column_mean_to_be_between",
    "expect_columns_ordered": "expect_table_columns_to_match_ordered_list",
    "expect_pair_greater": "expect_column_pair_values_a_to_be_greater_than_b",
    "expect_distinct_in_set": "expect_column_distinct_values_to_be_in_set",
    "expect_unique_proportion_between": "expect_column_proportion_of_unique_values_to_be_between",
}

# (query, table, kwargs, observed, success) with SQL over the same table.
_CASES = [
    ("expect_row_count_between", "lineitem", {"min_value": 1, "max_value": 50}, "count(*)", "o BETWEEN 1 AND 50"),
    ("expect_not_null", "events", {"column": "props"}, "count(*) FILTER (props IS NULL)", "o = 0"),
    (
        "expect_between",
        "lineitem",
        {"column": "l_quantity", "min_value": 2, "max_value": 48, "mostly": 0.9},
        "avg(CASE WHEN l_quantity BETWEEN 2 AND 48 THEN 1.0::DOUBLE ELSE 0 END)",
        "o >= 0.9",
    ),
    (
        "expect_in_set",
        "orders",
        {"column": "o_orderstatus", "value_set": ["F", "O"]},
        "count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))",
        "o = 0",
    ),
    ("expect_unique", "lineitem", {"column": "l_orderkey"}, "count(*) - count(DISTINCT l_orderkey)", "o = 0"),
    (
        "expect_match_regex",
        "part",
        {"column": "p_brand", "regex": "Brand#[1-3]", "mostly": 0.5},
        "avg(CASE WHEN regexp_matches(p_brand, '^(?:Brand#[1-3])') THEN 1.0::DOUBLE ELSE 0 END)",
        "o >= 0.5",
    ),
    (
        "expect_mean_between",
        "lineitem",
        {"column": "l_discount", "min_value": 0.01, "max_value": 0.09},
        "avg(l_discount)",
        "o BETWEEN 0.01 AND 0.09",
    ),
    (
        "expect_columns_ordered",
        "orders",
        {
            "column_list": [
                "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
            ]
        },
        "6 + 0 * count(*)",
        "true",
    ),
    (
        "expect_pair_greater",
        "lineitem",
        {"column_A": "l_extendedprice", "column_B": "l_quantity"},
        "count(*) FILTER (NOT l_extendedprice > l_quantity)",
        "o = 0",
    ),
    (
        "expect_distinct_in_set",
        "events",
        {"column": "event_type", "value_set": ["click", "view", "purchase"]},
        "count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase'))",
        "o = 0",
    ),
    (
        "expect_unique_proportion_between",
        "lineitem",
        {"column": "l_partkey", "min_value": 0.001, "max_value": 1.0},
        "count(DISTINCT l_partkey) / CAST(count(l_partkey) AS DOUBLE)",
        "o BETWEEN 0.001 AND 1.0",
    ),
]


def _register_case(name: str, table: str, kwargs: dict, observed: str, success: str) -> None:
    kind = _SHORT[name]
    column = kwargs.get("column") or kwargs.get("column_A")
    named = f"'{column}'" if column else "NULL"
    check = (
        f"SELECT '{kind}' AS expectation, {named} AS column_name, o AS observed, {success} AS success "
        f"FROM (SELECT {observed} AS o FROM {table})"
    )

    @query(name, "expectation column_name observed:4 success:b", sql=check)
    def _(t: Tables):
        return Q.run_suite(t[table], {"expectations": [{"expectation_type": kind, "kwargs": kwargs}]})


for _case in _CASES:
    _register_case(*_case)

ITEM_SUITE = {
    "expectation_suite_name": "line_items",
    "expectations": [
        {"expectation_type": _SHORT[n], "kwargs": k} for n, table, k, _, _ in _CASES if table == "lineitem"
    ]
    + [
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "no_such_column"}},
        {"expectation_type": "expect_something_else", "kwargs": {}},
    ],
}
_ITEM_CASES = [c for c in _CASES if c[1] == "lineitem"]
_SUITE_SQL = " UNION ALL ".join(
    [
        f"SELECT {i} AS position, '{_SHORT[n]}' AS expectation, o AS observed, {success} AS success, NULL AS note "
        f"FROM (SELECT CAST({observed} AS DOUBLE) AS o FROM lineitem)"
        for i, (n, _, _, observed, success) in enumerate(_ITEM_CASES)
    ]
    + [
        f"SELECT {len(_ITEM_CASES)}, 'expect_column_values_to_not_be_null', NULL, false, "
        "'Column ''no_such_column'' not found'",
        f"SELECT {len(_ITEM_CASES) + 1}, 'expect_something_else', NULL, true, "
        "'Skipped (not implemented): expect_something_else'",
    ]
)


@query("run_suite", "position:i expectation observed:4 success:b note", sql=_SUITE_SQL)
def _(t: Tables):
    return Q.run_suite(t["lineitem"], ITEM_SUITE)


@query(
    "suite_summary",
    "suite_name success:b total_expectations:i passed:i failed:i success_rate:4",
    sql=f"""SELECT 'line_items' AS suite_name, bool_and(success) AS success, count(*) AS total_expectations,
  count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed,
  round(count(*) FILTER (success) / CAST(count(*) AS DOUBLE), 4) AS success_rate FROM ({_SUITE_SQL})""",
)
def _(t: Tables):
    return Q.suite_summary(Q.run_suite(t["lineitem"], ITEM_SUITE), "line_items")


# ---------------------------------------------------------------- fairness

_APE = "abs(y_true - y_pred) / greatest(abs(y_true), 1.0)"
ROW_KEY = ["order_key", "line_number", "supplier_key", "line_price"]


@query(
    "group_mape",
    "group_label mape:4 n_samples:i",
    "predictions",
    f"SELECT group_label, avg({_APE}) * 100 AS mape, count(*) AS n_samples FROM predictions GROUP BY 1",
)
def _(t: Tables):
    return Y.group_mape(t["predictions"], "group_label", digits=None)


_REPLICATES = 1000
_SHARE = "CASE WHEN one > 0 THEN e / one * 100 END"


@query(
    "group_mape_ci",
    "group_label mape:4 ci_lower:4 ci_upper:4 n_samples:i",
    "predictions",
    f"""WITH r AS (SELECT *, {_APE} AS e FROM predictions),{R.sums("r", ROW_KEY, ["e"], ["group_label"], _REPLICATES)},
ci AS ({R.interval(_SHARE, ["group_label"])})
SELECT group_label, mape, ci_lower, ci_upper, n_samples FROM ci JOIN (SELECT group_label, avg(e) * 100 AS mape, count(*) AS n_samples
  FROM r GROUP BY 1) USING (group_label)""",
)
def _(t: Tables):
    return Y.group_mape_ci(t["predictions"], "group_label", ROW_KEY)


# The chi-squared tail for an even number of degrees of freedom is a finite sum.
def _even_tail(x: str, dof: str) -> str:
    return (
        f"list_sum(list_transform(range(0, CAST({dof} // 2 AS BIGINT)), "
        f"lambda k: exp(-{x} / 2 + k * ln({x} / 2) - lgamma(k + 1))))"
    )


@query(
    "kruskal_wallis",
    "H:4 n_groups:i p_value:6",
    "predictions",
    f"""WITH e AS (SELECT group_label AS g, {_APE} AS v FROM predictions),
t AS (SELECT v, count(*) AS t FROM e GROUP BY 1),
r AS (SELECT v, t, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2.0::DOUBLE AS rank FROM t),
n AS (SELECT CAST(sum(t) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM t),
g AS (SELECT g, sum(rank) AS r, count(*) AS c FROM e JOIN r ON e.v = r.v GROUP BY 1),
h AS (SELECT (12.0 / (any_value(n) * (any_value(n) + 1)) * sum(r * r / c) - 3.0 * (any_value(n) + 1))
  / (1 - any_value(ties) / (any_value(n) ** 3 - any_value(n))) AS "H", count(*) AS n_groups FROM g, n)
SELECT *, {_even_tail('"H"', '(n_groups - 1)')} AS p_value FROM h""",
)
def _(t: Tables):
    return Y.kruskal_wallis(t["predictions"], "group_label")


@query(
    "chi_squared_error_bins",
    "chi2:4 dof:i n_categories:i p_value:6",
    "predictions",
    f"""WITH e AS (SELECT group_label AS c, {_APE} AS v FROM predictions),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, max(v) AS q4 FROM e),
b AS (SELECT c, (CASE WHEN v >= q1 AND q1 < q4 THEN 1 ELSE 0 END) + (CASE WHEN v >= q2 AND q2 < q4 THEN 1 ELSE 0 END)
  + (CASE WHEN v >= q3 AND q3 < q4 THEN 1 ELSE 0 END) AS b FROM e, q),
o AS (SELECT c, b, count(*) AS o FROM b GROUP BY 1, 2),
f AS (SELECT cc.c, bb.b, coalesce(o, 0) AS o FROM (SELECT DISTINCT c FROM b) cc, (SELECT DISTINCT b FROM b) bb
  LEFT JOIN o ON o.c = cc.c AND o.b = bb.b),
x AS (SELECT *, CAST(sum(o) OVER (PARTITION BY c) AS DOUBLE) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS ex FROM f),
s AS (SELECT sum((o - ex) ** 2 / ex) AS chi2, (count(DISTINCT c) - 1) * (count(DISTINCT b) - 1) AS dof,
  count(DISTINCT c) AS n_categories FROM x)
SELECT *, {_even_tail('chi2', 'dof')} AS p_value FROM s""",
)
def _(t: Tables):
    return Y.chi_squared_error_bins(t["predictions"], "group_label")


SLICES_SQL = {
    "small_orders": "y_true < 10",
    "large_orders": "y_true >= 40",
    "promo": "category = 'PROMO'",
    "never": "y_true < 0",
}


@query(
    "slice_fairness",
    "segment mape:4 n_samples:i",
    "predictions",
    " UNION ALL ".join(
        f"SELECT '{n}' AS segment, avg({_APE}) * 100 AS mape, count(*) AS n_samples FROM predictions WHERE {p} "
        "HAVING count(*) > 0"
        for n, p in SLICES_SQL.items()
    ),
)
def _(t: Tables):
    return Y.slice_fairness(t["predictions"], {n: F.expr(p) for n, p in SLICES_SQL.items()}, digits=None)


@query(
    "slice_fairness_ci",
    "segment mape:4 ci_lower:4 ci_upper:4 n_samples:i",
    "predictions",
    "WITH r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS segment, *, {_APE} AS e FROM predictions WHERE {p}" for n, p in SLICES_SQL.items()) + "),"
    + R.sums("r", ROW_KEY, ["e"], ["segment"], _REPLICATES) + f""",
ci AS ({R.interval(_SHARE, ["segment"])})
SELECT segment, mape, ci_lower, ci_upper, n_samples FROM ci JOIN (SELECT segment, avg(e) * 100 AS mape, count(*) AS n_samples
  FROM r GROUP BY 1) USING (segment)""",
)
def _(t: Tables):
    return Y.slice_fairness_ci(t["predictions"], {n: F.expr(p) for n, p in SLICES_SQL.items()}, ROW_KEY)
