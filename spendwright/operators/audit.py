"""Audit log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verbs of HTTP methods and resources with their own prefix.
METHOD_VERBS = {"GET": "read", "POST": "create", "PUT": "update", "PATCH": "update", "DELETE": "delete"}
RESOURCE_PREFIXES = {"forecasts": "forecast", "drift": "drift", "experiments": "experiment"}


def audit_recent(
    log: DataFrame,
    limit: int = 100,
    user: object | None = None,
    action: str | None = None,
    outcome: str | None = None,
    tie_breaker: str | None = None,
) -> DataFrame:
    """The newest entries that match a user, action prefix and outcome."""
    if user is not None:
        log = log.where(F.col("user_name") == F.lit(user))
    if action is not None:
        log = log.where(F.col("action").startswith(action))
    if outcome is not None:
        log = log.where(F.col("outcome") == outcome)
    order = [F.desc("timestamp"), *([F.desc(tie_breaker)] if tie_breaker else [])]
    return log.orderBy(*order).limit(limit)


def audit_stats(log: DataFrame, top_actions: int = 10) -> DataFrame:
    """Totals, unique users, counts per outcome and the top actions.

    One row per figure: ``(metric, name, value)``.
    """
    counts = log.groupBy(
        F.coalesce("outcome", F.lit("unknown")).alias("outcome"), F.coalesce("action", F.lit("unknown")).alias("action")
    ).agg(F.count(F.lit(1)).alias("n"))
    name = F.lit(None).cast("string")
    total = counts.agg(F.sum("n").alias("value")).select(F.lit("total_entries").alias("metric"), name.alias("name"), "value")
    users = log.agg(F.count_distinct(F.coalesce(F.col("user_name").cast("string"), F.lit("unknown"))).alias("value"))
    users = users.select(F.lit("unique_users").alias("metric"), name.alias("name"), "value")
    outcomes = counts.groupBy("outcome").agg(F.sum("n").alias("value"))
    outcomes = outcomes.select(F.lit("outcome").alias("metric"), F.col("outcome").alias("name"), "value")
    actions = counts.groupBy("action").agg(F.sum("n").alias("value")).orderBy(F.desc("value"), "action")
    actions = actions.limit(top_actions).select(
        F.lit("top_action").alias("metric"), F.col("action").alias("name"), "value"
    )
    return total.unionByName(users).unionByName(outcomes).unionByName(actions)


def derive_audit_action(method: Column, path: Column) -> Column:
    """``resource.verb`` for an HTTP method and path."""
    segments = F.filter(F.split(F.trim(path, F.lit("/")), "/"), lambda s: (s != "") & (s != "api"))
    resource = F.try_element_at(segments, F.lit(1))
    second = F.try_element_at(segments, F.lit(2))
    verb = F.lower(method)
    for name, word in METHOD_VERBS.items():
        verb = F.when(method == name, word).otherwise(verb)
    prefix = resource
    for name, word in RESOURCE_PREFIXES.items():
        prefix = F.when(resource == name, word).otherwise(prefix)
    return (
        F.when(resource.isNull(), F.concat(F.lit("api."), F.lower(method)))
        .when((resource == "pipelines") & second.isNotNull(), F.concat(F.lit("pipeline."), second))
        .otherwise(F.concat_ws(".", prefix, verb))
    )
