"""Contract checks and expectation suites as single-pass aggregates."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendwright.sources.contracts import Contract, Rule

# ---------------------------------------------------------------- contracts


def _violations(name: str, rule: Rule) -> dict[str, Column]:
    """Row conditions that break the column's rule, by check name; NaN counts as missing."""
    raw = F.col(name)
    value = raw.try_cast(rule.dtype)
    checks = {"type": raw.isNotNull() & value.isNull()}
    missing = raw.isNull()
    if rule.dtype in ("double", "float"):
        missing = missing | F.isnan(value)
        value = F.when(~F.isnan(value), value)
    if not rule.nullable:
        checks["not_null"] = missing
    if rule.prefix is not None:
        checks["prefix"] = ~value.startswith(rule.prefix)
    if rule.isin is not None:
        checks["isin"] = ~value.isin(list(rule.isin))
    if rule.gt is not None:
        checks["gt"] = ~(value > rule.gt)
    if rule.ge is not None:
        checks["ge"] = ~(value >= rule.ge)
    if rule.between is not None:
        checks["between"] = ~value.between(*rule.between)
    return checks


def contract_check(df: DataFrame, contract: Contract, table: str) -> DataFrame:
    """Failures of every declared check: ``(table, column, check, failures)``.

    All row checks share one aggregate over one scan; a unique column adds one
    grouped count. A missing column fails its "present" check for all rows.
    """
    counts, labels = [], []
    for name, rule in contract.items():
        if name not in df.columns:
            labels.append((name, "present"))
            counts.append(F.count(F.lit(1)))
            continue
        for check, broken in _violations(name, rule).items():
            labels.append((name, check))
            counts.append(F.count(F.when(broken, 1)))
    row = df.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts)])
    facts = [
        F.struct(F.lit(n).alias("column"), F.lit(c).alias("check"), F.col(f"_{i}").alias("failures"))
        for i, (n, c) in enumerate(labels)
    ]
    for name, rule in contract.items():
        if rule.unique and name in df.columns:
            repeats = df.groupBy(name).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)))
            facts.append(
                F.struct(F.lit(name).alias("column"), F.lit("unique").alias("check"), repeats.scalar().alias("failures"))
            )
    return row.select(F.lit(table).alias("table"), F.inline(F.array(*facts)))


def failing_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows that break a row check, with the broken checks listed."""
    texts = [
        F.when(broken, F.lit(f"{name}:{check}"))
        for name, rule in contract.items()
        if name in df.columns
        for check, broken in _violations(name, rule).items()
    ]
    return df.withColumn("_failed", F.array_compact(F.array(*texts))).where(F.size("_failed") > 0)


def validate_all(tables: Mapping[str, DataFrame | None], contracts: Mapping[str, Contract]) -> DataFrame:
    """One row per contract: whether the table exists and passes all checks."""
    result: DataFrame | None = None
    for name, contract in contracts.items():
        df = tables.get(name)
        if df is None:
            continue
        checked = contract_check(df, contract, name)
        one = checked.groupBy("table").agg((F.sum("failures") == 0).alias("valid"), F.sum("failures").alias("failures"))
        result = one if result is None else result.unionByName(one)
    if result is None:
        raise ValueError("none of the contract tables is present")
    return result


# ---------------------------------------------------------------- suites


class _Plan:
    """Aggregates collected while expectations are compiled."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.aggregates: dict[str, Column] = {"_rows": F.count(F.lit(1))}
        self.scalars: dict[str, Column] = {}

    def add(self, aggregate: Column) -> Column:
        name = f"_a{len(self.aggregates)}"
        self.aggregates[name] = aggregate
        return F.col(name)

    def groups(self, column: str) -> Column:
        """(distinct values with null, distinct values without, non-null rows).

        Needs its own grouped count; asked for once per column.
        """
        if column not in self.scalars:
            counted = self.df.groupBy(F.col(column).alias("v")).count()
            facts = counted.agg(
                F.struct(
                    F.count(F.lit(1)).alias("groups"),
                    F.count("v").alias("distinct"),
                    F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("count"))), F.lit(0)).alias("filled"),
                )
            )
            self.scalars[column] = facts.scalar()
        return self.scalars[column]


def _bounds(value: Column, kwargs: Mapping[str, Any]) -> Column:
    inside = value.isNotNull()
    if kwargs.get("min_value") is not None:
        inside = inside & (value >= kwargs["min_value"])
    if kwargs.get("max_value") is not None:
        inside = inside & (value <= kwargs["max_value"])
    return inside


Outcome = tuple[Column, Column]


def _row_count(plan: _Plan, k: Mapping) -> Outcome:
    n = F.col("_rows")
    return _bounds(n, k), n


def _not_null(plan: _Plan, k: Mapping) -> Outcome:
    n = plan.add(F.count(F.when(F.col(k["column"]).isNull(), 1)))
    return n == 0, n


def _share(plan: _Plan, column: str, condition: Column) -> Column:
    """Share of non-null rows that meet a condition, null without rows."""
    return plan.add(F.avg(F.when(F.col(column).isNotNull(), F.when(condition, 1.0).otherwise(0.0))))


def _between(plan: _Plan, k: Mapping) -> Outcome:
    share = _share(plan, k["column"], _bounds(F.col(k["column"]), k))
    return F.coalesce(share >= float(k.get("mostly", 1.0)), F.lit(False)), F.bround(share, 4)


def _in_set(plan: _Plan, k: Mapping) -> Outcome:
    c = F.col(k["column"])
    outside = plan.add(F.count(F.when(c.isNotNull() & ~c.isin(list(k["value_set"])), 1)))
    return outside == 0, outside


def _unique(plan: _Plan, k: Mapping) -> Outcome:
    repeats = F.col("_rows") - plan.groups(k["column"])["groups"]
    return repeats == 0, repeats


def _regex(plan: _Plan, k: Mapping) -> Outcome:
    share = F.coalesce(_share(plan, k["column"], F.col(k["column"]).rlike(f"^(?:{k['regex']})")), F.lit(0.0))
    return share >= float(k.get("mostly", 1.0)), F.bround(share, 4)


def _mean(plan: _Plan, k: Mapping) -> Outcome:
    mean = plan.add(F.avg(k["column"]))
    return _bounds(mean, k), F.bround(mean, 4)


def _ordered_columns(plan: _Plan, k: Mapping) -> Outcome:
    return F.lit(plan.df.columns == list(k["column_list"])), F.lit(len(plan.df.columns))


def _pair_greater(plan: _Plan, k: Mapping) -> Outcome:
    a, b = F.col(k["column_A"]), F.col(k["column_B"])
    holds = (a >= b) if k.get("or_equal", False) else (a > b)
    broken = plan.add(F.count(F.when(~F.coalesce(holds, F.lit(False)), 1)))
    return broken == 0, broken


def _unique_proportion(plan: _Plan, k: Mapping) -> Outcome:
    g = plan.groups(k["column"])
    share = F.try_divide(g["distinct"].cast("double"), g["filled"].cast("double"))
    return _bounds(share, k), F.bround(share, 4)


EXPECTATIONS: dict[str, Callable[[_Plan, Mapping], Outcome]] = {
    "expect_table_row_count_to_be_between": _row_count,
    "expect_column_values_to_not_be_null": _not_null,
    "expect_column_values_to_be_between": _between,
    "expect_column_values_to_be_in_set": _in_set,
    "expect_column_values_to_be_unique": _unique,
    "expect_column_values_to_match_regex": _regex,
    "expect_column_mean_to_be_between": _mean,
    "expect_table_columns_to_match_ordered_list": _ordered_columns,
    "expect_column_pair_values_a_to_be_greater_than_b": _pair_greater,
    "expect_column_distinct_values_to_be_in_set": _in_set,
    "expect_column_proportion_of_unique_values_to_be_between": _unique_proportion,
}


def load_suite(text: str) -> dict:
    """A suite document from JSON text."""
    return json.loads(text)


def run_suite(df: DataFrame, suite: Mapping) -> DataFrame:
    """One row per expectation: ``(position, expectation, column_name, success, observed, note)``.

    All expectations share one aggregate over one scan; columns checked for
    uniqueness add one grouped count each. An expectation on a missing column
    fails, an unknown expectation passes with a note.
    """
    plan = _Plan(df)
    compiled = []
    for position, item in enumerate(suite.get("expectations", [])):
        kind, kwargs = item["expectation_type"], item.get("kwargs", {})
        column = kwargs.get("column") or kwargs.get("column_A")
        missing = [c for key in ("column", "column_A", "column_B") if (c := kwargs.get(key)) and c not in df.columns]
        note = F.lit(None).cast("string")
        if kind not in EXPECTATIONS:
            success, observed, note = F.lit(True), F.lit(None), F.lit(f"Skipped (not implemented): {kind}")
        elif missing:
            text = "Column(s) not found" if "column_A" in kwargs else f"Column {missing[0]!r} not found"
            success, observed, note = F.lit(False), F.lit(None), F.lit(text)
        else:
            success, observed = EXPECTATIONS[kind](plan, kwargs)
        compiled.append((position, kind, column, success, observed, note))
    if not compiled:
        raise ValueError("the suite has no expectations")
    row = df.agg(*[a.alias(n) for n, a in plan.aggregates.items()])
    facts = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(kind).alias("expectation"),
            F.lit(column).cast("string").alias("column_name"),
            F.coalesce(success, F.lit(False)).alias("success"),
            observed.cast("double").alias("observed"),
            note.alias("note"),
        )
        for position, kind, column, success, observed, note in compiled
    ]
    return row.select(F.inline(F.array(*facts)))


def suite_summary(results: DataFrame, suite_name: str) -> DataFrame:
    """Passed, failed and success rate of a suite's result rows."""
    counts = results.agg(
        F.count(F.lit(1)).alias("total_expectations"), F.count(F.when(F.col("success"), 1)).alias("passed")
    )
    total, passed = F.col("total_expectations"), F.col("passed")
    return counts.select(
        F.lit(suite_name).alias("suite_name"),
        (total == passed).alias("success"),
        total,
        passed,
        (total - passed).alias("failed"),
        F.bround(F.when(total > 0, passed / total).otherwise(0.0), 4).alias("success_rate"),
    )
