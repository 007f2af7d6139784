"""Distribution drift, forecast-error drift, retraining and model verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwright.functions.grids import digits_of, explode_values
from spendwright.functions.tails import ks_two_sample_sf_udf
from spendwright.operators.ordering import Ordered
from spendwright.sources.session import sized

# Drift thresholds.
KS_ALERT = 0.05
KS_RETRAIN = 0.01
PSI_ALERT = 0.1
PSI_RETRAIN = 0.2
PSI_EPSILON = 1e-6
PSI_BINS = 10
MAPE_THRESHOLD = 0.20
CONSECUTIVE_DAYS = 7
RELATIVE_MAPE = 0.50

# Metrics where a smaller number is better.
LOWER_IS_BETTER = ("mape", "wmape", "rmse", "mae", "loss", "error")
COMPARED_METRICS = ("mape", "rmse", "wmape", "auuc")


def numeric_columns(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns both frames have, in the reference's order."""
    numeric = {f.name for f in reference.schema if isinstance(f.dataType, T.NumericType)}
    wanted = columns or reference.columns
    return [c for c in wanted if c in numeric and c in current.columns]


def _long(df: DataFrame, columns: Sequence[str], by: Sequence[str], side: int) -> DataFrame:
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    long = values.unpivot(list(by), list(columns), "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("_cur", F.lit(side))


def _both(reference: DataFrame, current: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return _long(reference, columns, by, 0).unionByName(_long(current, columns, by, 1))


def _severity(value: Column, alert: Column, retrain: Column) -> Column:
    return F.when(retrain, "AUTO_RETRAIN").when(alert, "ALERT").otherwise("OK")


def ks_statistics(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and tail per feature.

    Both samples are first compressed to counts per distinct value, then
    accumulated in global value order. The tail is exact up to 10,000 values a
    sample, and corrected for the finite size above.
    """
    names = numeric_columns(reference, current, columns)
    keys = [*by, "feature"]
    counts = (
        _both(reference, current, names, by)
        .groupBy(*keys, "value")
        .agg(F.sum(1 - F.col("_cur")).alias("r"), F.sum("_cur").alias("c"))
    )
    ordered = Ordered(counts, [F.col("value")], keys)
    sums = ordered.running_sum({"fr": F.col("r"), "fc": F.col("c")})
    totals = ordered.rows.groupBy(*keys).agg(F.sum("r").alias("n_reference"), F.sum("c").alias("n_current"))
    distance = F.max(F.abs(F.col("fr") / F.col("n_reference") - F.col("fc") / F.col("n_current")))
    usable = totals.where((F.col("n_reference") >= 2) & (F.col("n_current") >= 2))
    joined = sums.join(sized(usable, "ks-totals"), keys).groupBy(*keys, "n_reference", "n_current").agg(distance.alias("statistic"))
    nr, nc = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    return joined.withColumn("p_value", ks_two_sample_sf_udf(nr, nc, F.col("statistic")))


def data_drift_ks(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    threshold: float = KS_ALERT,
) -> DataFrame:
    """Drift verdict per numeric feature, most drifted first."""
    p = F.col("p_value")
    return (
        ks_statistics(reference, current, columns, by)
        .withColumn("is_drifted", p < threshold)
        .withColumn("action", _severity(p, p < threshold, p < KS_RETRAIN))
        .orderBy("p_value")
    )


def population_stability(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    n_bins: int = PSI_BINS,
    bins: str = "reference",
) -> DataFrame:
    """Population stability index per feature over equal-width bins.

    ``bins="reference"``: edges span the reference sample, values outside are
    dropped, empty shares become a small constant. ``bins="joint"``: edges span
    both samples and the constant is added to every share.
    """
    if bins not in ("reference", "joint"):
        raise ValueError("bins must be 'reference' or 'joint'")
    joint = bins == "joint"
    keys = [*by, "feature"]
    rows = _both(reference, current, numeric_columns(reference, current, columns), by)
    spanned = F.col("value") if joint else F.when(F.col("_cur") == 0, F.col("value"))
    # One row per feature (and group): the bin borders.
    bounds = rows.groupBy(*keys).agg(F.min(spanned).alias("_lo"), F.max(spanned).alias("_hi"))
    placed = rows.join(sized(bounds, "psi-bounds"), keys)
    value, lo, hi = F.col("value"), F.col("_lo"), F.col("_hi")
    step = (hi - lo) / n_bins
    index = reduce(lambda a, i: a + F.when(value >= lo + step * i, 1).otherwise(0), range(1, n_bins), F.lit(0))
    slack = 0.0 if joint else PSI_EPSILON
    placed = placed.withColumn("_bin", F.when((value >= lo - slack) & (value <= hi + slack), index))
    counts = placed.groupBy(*keys).agg(
        F.max(hi - lo).alias("_width"),
        *[
            F.count(F.when((F.col("_cur") == s) & inside, 1)).alias(f"_{n}")
            for s, side in enumerate("rc")
            for n, inside in [
                (f"{side}_all", F.lit(True)),
                *[(f"{side}{i}", F.col("_bin") == i) for i in range(n_bins)],
            ]
        ],
    )

    def share(side: str, i: int) -> Column:
        count = F.col(f"_{side}{i}")
        if joint:
            return count / F.col(f"_{side}_all") + PSI_EPSILON
        inside = reduce(lambda a, j: a + F.col(f"_{side}{j}"), range(1, n_bins), F.col(f"_{side}0"))
        return F.when(count == 0, F.lit(PSI_EPSILON)).otherwise(count / (inside + PSI_EPSILON))

    def term(i: int) -> Column:
        r, c = share("r", i), share("c", i)
        return (c - r) * F.ln(c / r)

    total = reduce(lambda a, i: a + term(i), range(1, n_bins), term(0))
    known = (F.col("_r_all") > 0) & (F.col("_c_all") > 0)
    psi = F.when(known & (F.col("_width") > 0), total).otherwise(0.0)
    return counts.select(
        *keys, F.col("_r_all").alias("n_reference"), F.col("_c_all").alias("n_current"), psi.alias("psi")
    )


def prediction_drift_psi(
    reference: DataFrame, current: DataFrame, prediction: str, by: Sequence[str] = (), threshold: float = PSI_ALERT
) -> DataFrame:
    """Stability verdict for a prediction column."""
    psi = population_stability(reference, current, [prediction], by)
    v = F.col("psi")
    return psi.withColumn("is_drifted", v >= threshold).withColumn(
        "action", _severity(v, v >= threshold, v >= PSI_RETRAIN)
    )


def serving_drift(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    threshold_ks: float = 0.05,
    threshold_psi: float = 0.20,
) -> DataFrame:
    """Kolmogorov-Smirnov and joint-bin stability side by side per feature."""
    keys = [*by, "feature"]
    ks = ks_statistics(reference, current, columns, by).select(
        *keys, F.col("statistic").alias("ks_statistic"), F.col("p_value").alias("ks_pvalue")
    )
    psi = population_stability(reference, current, columns, by, bins="joint").select(*keys, "psi")
    joined = ks.join(psi, keys)
    return (
        joined.withColumn("ks_drift", F.col("ks_pvalue") < threshold_ks)
        .withColumn("psi_drift", F.col("psi") > threshold_psi)
        .withColumn("drift_detected", F.col("ks_drift") | F.col("psi_drift"))
    )


# ---------------------------------------------------------------- error drift


def concept_drift(
    history: DataFrame,
    model: str = "model_id",
    ts: str = "ds",
    threshold: float = MAPE_THRESHOLD,
    consecutive_days: int = CONSECUTIVE_DAYS,
) -> DataFrame:
    """Length of the trailing run of high errors per model, with the verdict.

    An error that is null or NaN is not high and left out of the mean.
    """
    high = F.coalesce((F.col("mape") > threshold) & ~F.isnan("mape"), F.lit(False))
    last_ok = history.groupBy(model).agg(
        F.max(F.when(~high, F.col(ts))).alias("_ok"), F.count(F.lit(1)).alias("history_length")
    )
    # One row per model on the right; rows before the run are dropped early.
    last_ok = sized(last_ok, "last-ok")
    run = history.join(last_ok.select(model, "_ok"), model).where(F.col("_ok").isNull() | (F.col(ts) > F.col("_ok")))
    run = run.groupBy(model).agg(F.count(F.lit(1)).alias("_run"))
    # The row-number limit is applied before the shuffle (window group limit).
    newest = Window.partitionBy(model).orderBy(F.desc(ts), F.desc(F.nanvl("mape", F.lit(None))))
    recent = history.withColumn("_i", F.row_number().over(newest)).where(F.col("_i") <= consecutive_days)
    recent = recent.groupBy(model).agg(F.avg(F.nanvl("mape", F.lit(None))).alias("statistic"))
    joined = last_ok.join(recent, model).join(run, model, "left")
    n = F.coalesce("_run", F.lit(0))
    return joined.select(
        model,
        "statistic",
        n.alias("consecutive_count"),
        "history_length",
        (n >= consecutive_days).alias("is_drifted"),
        F.when(n >= consecutive_days, "AUTO_RETRAIN").when(n > 0, "ALERT").otherwise("OK").alias("action"),
    )


def _reason(concept: Column, data: Column) -> Column:
    return (
        F.when(concept & data, "CONCEPT_AND_DATA_DRIFT")
        .when(concept, "CONCEPT_DRIFT_MAPE")
        .when(data, "DATA_DRIFT_AUTO_RETRAIN")
        .otherwise("OK")
    )


def retrain_verdict(concept: DataFrame, data_drift: DataFrame | None = None, model: str = "model_id") -> DataFrame:
    """Whether to retrain each model and why.

    ``data_drift`` holds one row per tested feature (of all models, or per
    model when it has the model column); triggering features are listed.
    """
    features = F.lit(None).cast("array<string>")
    if data_drift is not None:
        severe = data_drift.where(F.col("action") == "AUTO_RETRAIN")
        # Bounded by the number of feature columns.
        listed = F.array_sort(F.collect_list("feature")).alias("_f")
        if model in data_drift.columns:
            concept = concept.join(severe.groupBy(model).agg(listed), model, "left")
        else:
            concept = concept.withColumn("_f", severe.agg(listed).scalar())
        features = F.col("_f")
    features = F.coalesce(features, F.array().cast("array<string>"))
    by_concept, by_data = F.col("action") == "AUTO_RETRAIN", F.size(features) > 0
    return concept.select(
        model,
        (by_concept | by_data).alias("should_retrain"),
        _reason(by_concept, by_data).alias("reason"),
        "consecutive_count",
        F.col("statistic").alias("concept_drift_statistic"),
        by_data.alias("data_drift_triggered"),
        features.alias("triggering_features"),
    )


def retrain_history(
    history: DataFrame,
    model: str = "model_id",
    ts: str = "ds",
    threshold: float = MAPE_THRESHOLD,
    consecutive_days: int = CONSECUTIVE_DAYS,
    reset_before: str | None = None,
    data_triggered: str | None = None,
) -> DataFrame:
    """The verdict after every single check.

    ``reset_before`` marks checks before which the history was cleared. Runs
    are counted in global (model, time) order, so a model with any number of
    checks is spread over many tasks.
    """
    above = F.col("mape") > threshold
    reset = F.coalesce(F.col(reset_before), F.lit(False)) if reset_before else F.lit(False)
    ordered = Ordered(history, [F.col(ts)], [model])
    numbered = ordered.running_sum({"_rn": F.lit(1)})
    breaks = F.when(~above, F.col("_rn")).when(reset, F.col("_rn") - 1)
    broken = ordered.running_max({"_break": breaks}, numbered)
    count = F.col("_rn") - F.coalesce("_break", F.lit(0))
    by_concept = count >= consecutive_days
    by_data = F.coalesce(F.col(data_triggered), F.lit(False)) if data_triggered else F.lit(False)
    return broken.select(
        model,
        ts,
        F.col("mape").alias("current_mape"),
        count.alias("consecutive_count"),
        (by_concept | by_data).alias("should_retrain"),
        _reason(by_concept, by_data).alias("reason"),
    )


def relative_mape_drift(
    current: DataFrame, baseline: DataFrame, model: str = "model_id", threshold: float = RELATIVE_MAPE
) -> DataFrame:
    """Relative increase of the error against its baseline."""
    joined = baseline.select(model, F.col("mape").alias("baseline")).join(
        current.select(model, F.col("mape").alias("current")), model
    )
    change = F.try_divide(F.col("current") - F.col("baseline"), F.col("baseline"))
    return joined.withColumn("relative_change", change).withColumn("drifted", F.col("relative_change") > threshold)


def monitoring_verdict(checks: DataFrame, mape: str, feature: str, prediction: str) -> DataFrame:
    """Retrain if any of three checks drifted, with the reasons."""
    flags = {"MAPE drift": mape, "feature drift": feature, "prediction drift": prediction}
    on = {text: F.coalesce(F.col(c), F.lit(False)) for text, c in flags.items()}
    reasons = F.array_compact(F.array(*[F.when(flag, F.lit(text)) for text, flag in on.items()]))
    needed = F.size(reasons) > 0
    return (
        checks.withColumn("needs_retrain", needed)
        .withColumn("reasons", F.concat_ws(", ", reasons))
        .withColumn("next_step", F.when(needed, "trigger_retrain").otherwise("no_action"))
    )


# ---------------------------------------------------------------- models


def _shared_metrics(metrics: DataFrame, model: str) -> DataFrame:
    """Champion and challenger values side by side per metric."""

    def value(role: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col("value")))

    return metrics.groupBy(model, "metric").agg(
        value("challenger").alias("challenger"), value("champion").alias("champion")
    )


def champion_challenger(metrics: DataFrame, model: str = "model_id") -> DataFrame:
    """Promote a challenger that wins on every shared metric.

    A metric is better when lower if its name contains an error word.
    """
    lower = reduce(lambda a, w: a | F.lower("metric").contains(w), LOWER_IS_BETTER[1:],
                   F.lower("metric").contains(LOWER_IS_BETTER[0]))
    pairs = _shared_metrics(metrics, model)
    shared = F.col("challenger").isNotNull() & F.col("champion").isNotNull()
    wins = F.when(lower, F.col("challenger") < F.col("champion")).otherwise(F.col("challenger") > F.col("champion"))
    verdict = pairs.groupBy(model).agg(
        F.count(F.when(shared, 1)).alias("shared_metrics"), F.bool_and(F.when(shared, wins)).alias("_all")
    )
    return verdict.select(
        model,
        "shared_metrics",
        F.when(F.coalesce("_all", F.lit(False)), "promoted").otherwise("retained").alias("verdict"),
    )


def model_comparison(
    metrics: DataFrame, model: str = "model_id", metric_keys: Sequence[str] = COMPARED_METRICS
) -> DataFrame:
    """Wins and losses per metric: promote, retain or mixed."""
    pairs = _shared_metrics(metrics.where(F.col("metric").isin(list(metric_keys))), model)
    shared = F.col("challenger").isNotNull() & F.col("champion").isNotNull()
    lower = F.col("metric").isin(list(LOWER_IS_BETTER))
    better = F.when(lower, F.col("challenger") < F.col("champion")).otherwise(F.col("challenger") > F.col("champion"))
    counts = pairs.groupBy(model).agg(
        F.count(F.when(shared & better, 1)).alias("wins"), F.count(F.when(shared & ~better, 1)).alias("losses")
    )
    verdict = (
        F.when((F.col("wins") > 0) & (F.col("losses") == 0), "promote")
        .when((F.col("losses") > 0) & (F.col("wins") == 0), "retain")
        .otherwise("mixed")
    )
    return counts.withColumn("verdict", verdict)


# ---------------------------------------------------------------- forecast

# Fixed values of the routed forecast.
COLD_START_ROWS = 60
INTERMITTENT_SHARE = 0.30
BASE_ROWS = 30
INTERVAL_Z = 1.645


def series_forecast(
    series: DataFrame, horizon: int = 14, include_ci: bool = True, digits: int | None = 2
) -> DataFrame:
    """Route each series and extend the trend of its last rows."""
    whole = series.groupBy("unique_id").agg(
        F.count("y").alias("n"), F.avg((F.col("y") == 0).cast("double")).alias("zero_share"), F.max("ds").alias("last_ds")
    )
    newest = Window.partitionBy("unique_id").orderBy(F.desc("ds"))
    tail = series.withColumn("_i", F.row_number().over(newest)).where(F.col("_i") <= BASE_ROWS)
    fit = tail.groupBy("unique_id").agg(
        F.avg("y").alias("base"),
        F.coalesce(F.regr_slope("y", -F.col("_i")), F.lit(0.0)).alias("trend"),
        F.stddev_pop("y").alias("spread"),
    )
    cold, sparse = F.col("n") < COLD_START_ROWS, F.col("zero_share") > INTERMITTENT_SHARE
    routed = whole.join(fit, "unique_id").select(
        "*",
        F.when(cold, "chronos_zs").when(sparse, "sarimax").otherwise("lightgbm").alias("model_used"),
        F.when(cold, F.format_string("Cold start: only %d days of history (<60)", "n"))
        .when(
            sparse,
            F.format_string("Intermittent demand: %d%% zero days (>30%%)", F.bround(F.col("zero_share") * 100, 0).cast("int")),
        )
        .otherwise("Mature SKU with sufficient non-zero history")
        .alias("routing_reason"),
    )
    steps = explode_values(routed, "step", list(range(1, horizon + 1)))
    point = digits_of(F.greatest(F.lit(0.0), F.col("base") + F.col("trend") * F.col("step")), digits)
    steps = steps.withColumn("point_forecast", point)
    margin = INTERVAL_Z * F.col("spread")
    low = digits_of(F.greatest(F.lit(0.0), F.col("point_forecast") - margin), digits)
    high = digits_of(F.col("point_forecast") + margin, digits)
    none = F.lit(None).cast("double")
    return steps.select(
        "unique_id",
        "step",
        F.date_add("last_ds", F.col("step")).alias("ds"),
        "model_used",
        "routing_reason",
        "point_forecast",
        (low if include_ci else none).alias("lower_90"),
        (high if include_ci else none).alias("upper_90"),
    )
