"""The named reports: run one, explain one, run all."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from spendwright.operators import reports as R

log = logging.getLogger(__name__)

TableSet = Mapping[str, DataFrame]

REPORTS: dict[str, Callable[[TableSet], DataFrame]] = {
    "cost_variance": lambda t: R.cost_variance(t["fact_cost_transactions"], t["dim_plant"], t["dim_product"]),
    "should_cost_gap": lambda t: R.should_cost_gap(t["fact_cost_transactions"], t["dim_product"]),
    "supplier_performance": lambda t: R.supplier_performance(
        t["fact_purchase_orders"], t["dim_supplier"], t["fact_quality_events"]
    ),
    "cost_anomaly": lambda t: R.cost_anomaly(t["fact_cost_transactions"]),
}


def report(tables: TableSet, name: str) -> DataFrame:
    """The named report over ``tables``."""
    if name not in REPORTS:
        raise KeyError(f"unknown report {name!r}; available: {sorted(REPORTS)}")
    return REPORTS[name](tables)


def explain_report(tables: TableSet, name: str) -> str:
    """The formatted physical plan of a report."""
    df = report(tables, name)
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def run_all_reports(tables: TableSet, sink: Callable[[str, DataFrame], None]) -> dict[str, str]:
    """Send every report to ``sink(name, df)``; a failing one is logged and skipped.

    Returns "ok" or the error text per report. Analysis errors and errors of
    the sink's own action both count as that report's failure.
    """
    status: dict[str, str] = {}
    for name in REPORTS:
        try:
            sink(name, report(tables, name))
            status[name] = "ok"
        except Exception as error:  # isolate reports from each other
            log.warning("report %s failed: %s", name, error)
            status[name] = str(error)
    return status
