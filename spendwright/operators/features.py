"""Leakage-safe time-series features and their joins.

Series hold one row per (series, day), so a window over one series is bounded
by the number of calendar days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS = (1, 7, 14, 28)
ROLLING_WINDOWS = (7, 28)
MOMENTUM_LAG = 3

# How ids name their region, product and site.
REGION_PATTERN = r"FC_([A-Z]{2}_[A-Z_]+)$"
SKU_PATTERN = r"^(SKU_\d+)"
SITE_PATTERN = r"__(FC_\S+)$"
UNKNOWN_REGION = "UNKNOWN"


def _extract(text: str, pattern: str) -> Column:
    """The first capture group, null where the pattern does not match."""
    return F.nullif(F.regexp_extract(F.col(text), pattern, 1), F.lit(""))


def validate_series(series: DataFrame) -> DataFrame:
    """Check that the series columns are present."""
    missing = {"unique_id", "ds", "y"} - set(series.columns)
    if missing:
        raise ValueError(f"series lacks columns {sorted(missing)}")
    return series


def lag_rolling_features(
    series: DataFrame, lags: Sequence[int] = LAGS, windows: Sequence[int] = ROLLING_WINDOWS
) -> DataFrame:
    """Lags, rolling mean and deviation of the past, weekday and month.

    Every value comes from earlier rows only; all windows share one sort.
    """
    order = Window.partitionBy("unique_id").orderBy("ds")
    columns: list[Column] = [F.lag("y", k).over(order).alias(f"lag_{k}") for k in lags]
    for w in windows:
        past = order.rowsBetween(-w, -1)
        columns.append(F.avg("y").over(past).alias(f"rolling_mean_{w}"))
        columns.append(F.stddev_samp("y").over(past).alias(f"rolling_std_{w}"))
    return validate_series(series).select(
        "*", *columns, F.weekday("ds").alias("day_of_week"), F.month("ds").alias("month")
    )


def momentum_lag_join(features: DataFrame, momentum: DataFrame, lag_rows: int = MOMENTUM_LAG) -> DataFrame:
    """Attach the daily mean momentum of ``lag_rows`` signal rows earlier."""
    daily = momentum.groupBy("ds").agg(F.avg("net_momentum").alias("_m"))
    shifted = daily.select(
        "ds", F.lag("_m", lag_rows).over(Window.partitionBy(F.lit(0)).orderBy("ds")).alias("social_momentum_t3")
    )
    # One row per calendar day, whatever the size of the inputs.
    return features.join(F.broadcast(shifted), "ds", "left")


def climate_join(features: DataFrame, climate: DataFrame) -> DataFrame:
    """Attach temperature and humidity of the series' region and day."""
    region = F.coalesce(_extract("unique_id", REGION_PATTERN), F.lit(UNKNOWN_REGION))
    right = climate.select(
        "ds",
        F.col("region").alias("_region"),
        F.col("temperature_celsius").alias("temperature"),
        F.col("humidity_pct").alias("humidity"),
    )
    return features.withColumn("_region", region).join(right, ["ds", "_region"], "left").drop("_region")


def days_to_expiry_join(features: DataFrame, inventory: DataFrame) -> DataFrame:
    """Attach the days until the nearest expiry of the series' stock."""
    nearest = inventory.groupBy("snapshot_date", "sku_id", "fc_id").agg(F.min("expiry_date").alias("_e"))
    right = nearest.select(
        F.col("snapshot_date").alias("ds"),
        F.col("sku_id").alias("_sku"),
        F.col("fc_id").alias("_site"),
        F.datediff("_e", "snapshot_date").cast("double").alias("days_to_expiry"),
    )
    keyed = features.withColumn("_sku", _extract("unique_id", SKU_PATTERN)).withColumn(
        "_site", _extract("unique_id", SITE_PATTERN)
    )
    return keyed.join(right, ["ds", "_sku", "_site"], "left").drop("_sku", "_site")


def materialize_features(
    series: DataFrame,
    momentum: DataFrame | None = None,
    climate: DataFrame | None = None,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """All features; a missing optional input gives null columns."""
    features = lag_rolling_features(series)
    missing = F.lit(None).cast("double")
    if momentum is not None:
        features = momentum_lag_join(features, momentum)
    else:
        features = features.withColumn("social_momentum_t3", missing)
    if climate is not None:
        features = climate_join(features, climate)
    else:
        features = features.withColumn("temperature", missing).withColumn("humidity", missing)
    if inventory is not None:
        return days_to_expiry_join(features, inventory)
    return features.withColumn("days_to_expiry", missing)


def training_slice(
    features: DataFrame,
    ids: DataFrame | Sequence | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """Rows of the listed series inside an inclusive date range and, if given, on the days of a table.

    Over a store that is partitioned by day the range prunes its folders when
    the query is planned, the table of days (column ``ds``) when it runs.
    """
    if days is not None:
        features = features.join(days.select("ds"), "ds", "left_semi")
    if start is not None:
        features = features.where(F.col("ds") >= F.lit(start).cast("date"))
    if end is not None:
        features = features.where(F.col("ds") <= F.lit(end).cast("date"))
    if isinstance(ids, DataFrame):
        return features.join(ids.select("unique_id"), "unique_id", "left_semi")
    return features if ids is None else features.where(F.col("unique_id").isin(list(ids)))


def latest_snapshot(features: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The last feature row of every series; listed ids without rows get nulls."""
    rest = [c for c in features.columns if c != "unique_id"]
    latest = features.groupBy("unique_id").agg(F.max_by(F.struct(*rest), "ds").alias("_last"))
    latest = latest.select("unique_id", "_last.*")
    return latest if ids is None else ids.select("unique_id").distinct().join(latest, "unique_id", "left")
