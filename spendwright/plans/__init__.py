"""Named reports and the queries built on the operators."""

from __future__ import annotations

import importlib

_MODULES = ("cost_queries", "experiment_queries", "monitoring_queries", "quality_queries", "causal_queries", "streaming_queries")


def load_queries():
    """All registered queries by name."""
    from spendwright.plans.registry import REGISTRY

    for module in _MODULES:
        importlib.import_module(f"spendwright.plans.{module}")
    return REGISTRY
