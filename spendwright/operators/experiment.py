"""Bucketing, sample-ratio checks, CUPED, sequential tests and sample sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendwright.functions.grids import explode_values
from spendwright.functions.hashing import sha256_bucket
from spendwright.functions.tails import chi2_sf_udf
from spendwright.operators.bootstrap import bootstrap_sums, percentile_interval
from spendwright.sources.session import sized

VARIANCE_FLOOR = 1e-12
DEFAULT_RHO = 0.74


# ---------------------------------------------------------------- assignment


def resolve_salt(
    default_salt: str, layers: Mapping[str, str] | None = None, layer: Column | None = None, salt: Column | str | None = None
) -> Column:
    """An explicit salt, else the layer's salt, else the default."""
    options: list[Column] = []
    if salt is not None:
        options.append(F.lit(salt) if isinstance(salt, str) else salt)
    if layers and layer is not None:
        table = F.create_map(*[F.lit(v) for pair in layers.items() for v in pair])
        options.append(F.try_element_at(table, layer))
    return F.coalesce(*options, F.lit(default_salt))


def assign_bucket(units: DataFrame, unit: str, salt: Column, n_buckets: int = 1000) -> DataFrame:
    """Add the ``bucket`` of each unit."""
    return units.withColumn("bucket", sha256_bucket(F.concat(salt, F.col(unit).cast("string")), n_buckets))


def assign_group(bucketed: DataFrame, splits: Mapping[str, float], n_buckets: int = 1000) -> DataFrame:
    """Add the ``group`` that covers a unit's bucket; the remainder is null."""
    if any(share <= 0 for share in splits.values()):
        raise ValueError("every split must be > 0")
    if sum(splits.values()) > 1.0 + 1e-9:
        raise ValueError("splits add up to more than 1")
    position = F.col("bucket") / F.lit(float(n_buckets))
    group, upper = F.lit(None).cast("string"), 0.0
    bounds = []
    for name, share in splits.items():
        upper += share
        bounds.append((name, upper))
    for name, bound in reversed(bounds):
        group = F.when(position < bound, name).otherwise(group)
    return bucketed.withColumn("group", group)


def assign_batch(
    units: DataFrame,
    unit: str,
    splits: Mapping[str, float],
    default_salt: str,
    n_buckets: int = 1000,
    layers: Mapping[str, str] | None = None,
    layer: Column | None = None,
    salt: Column | str | None = None,
) -> DataFrame:
    """Bucket and group for every unit in one projection."""
    resolved = resolve_salt(default_salt, layers, layer, salt)
    return assign_group(assign_bucket(units, unit, resolved, n_buckets), splits, n_buckets)


def srm_check(
    assignments: DataFrame, expected: Mapping[str, float], by: Sequence[str] = (), alpha: float = 0.01
) -> DataFrame:
    """Chi-squared test of group counts against intended shares."""
    if any(r <= 0 for r in expected.values()):
        raise ValueError("every expected ratio must be > 0")
    total_ratio = sum(expected.values())
    counts = assignments.groupBy(*by).agg(
        *[F.count(F.when(F.col("group") == g, 1)).alias(f"n_{g}") for g in expected]
    )
    n = sum((F.col(f"n_{g}") for g in list(expected)[1:]), F.col(f"n_{next(iter(expected))}"))
    chi2 = F.lit(0.0)
    for g, ratio in expected.items():
        want = n * F.lit(ratio / total_ratio)
        chi2 = chi2 + F.try_divide((F.col(f"n_{g}") - want) * (F.col(f"n_{g}") - want), want)
    dof = len(expected) - 1
    tested = counts.withColumn("chi2_statistic", chi2).withColumn("degrees_of_freedom", F.lit(dof))
    tested = tested.withColumn("p_value", chi2_sf_udf("chi2_statistic", F.lit(float(dof))))
    return tested.withColumn("is_srm", F.col("p_value") < alpha)


def bucket_distribution(bucketed: DataFrame, n_buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """Uniformity of bucket counts over all buckets, empty ones included."""
    counts = bucketed.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy(*by).agg(
        F.sum("c").alias("n_units"),
        F.count(F.lit(1)).alias("_used"),
        F.min("c").alias("_min"),
        F.max("c").alias("max_count"),
        F.sum(F.col("c").cast("double") * F.col("c")).alias("_squares"),
    )
    expected = F.col("n_units") / F.lit(float(n_buckets))
    lowest = F.when(F.col("_used") < n_buckets, 0).otherwise(F.col("_min"))
    deviation = F.greatest(F.col("max_count") - expected, expected - lowest)
    shaped = sums.select(
        *by,
        "n_units",
        lowest.alias("min_count"),
        "max_count",
        (deviation / F.greatest(expected, F.lit(1e-9)) * 100).alias("max_deviation_pct"),
        # sum of (c - e)^2 / e over all buckets, with sum of c = n_buckets * e
        (F.col("_squares") / expected - F.col("n_units")).alias("chi2_statistic"),
    )
    return shaped.withColumn("p_value", chi2_sf_udf("chi2_statistic", F.lit(float(n_buckets - 1))))


# ---------------------------------------------------------------- CUPED


def cuped_fit(df: DataFrame, pre: str, post: str, by: Sequence[str] = ()) -> DataFrame:
    """Control-variate coefficient, correlation and covariate mean."""
    moments = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_samp(pre).alias("_vx"),
        F.var_samp(post).alias("_vy"),
        F.covar_samp(post, pre).alias("_c"),
        F.avg(pre).alias("mean_pre"),
    )
    flat = F.coalesce(F.col("_vx"), F.lit(0.0)) < VARIANCE_FLOOR
    rho = F.when(flat | (F.sqrt("_vy") <= VARIANCE_FLOOR), F.lit(0.0)).otherwise(
        F.col("_c") / (F.sqrt("_vy") * F.sqrt("_vx"))
    )
    return moments.select(
        *by,
        "n",
        F.when(flat, F.lit(0.0)).otherwise(F.col("_c") / F.col("_vx")).alias("theta"),
        rho.alias("rho"),
        "mean_pre",
        (1.0 - rho * rho).alias("remaining_variance"),
    )


def cuped_transform(df: DataFrame, fit: DataFrame, pre: str, post: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``adjusted``: the outcome without its covariate part."""
    if by:
        joined = df.join(sized(fit.select(*by, "theta", "mean_pre"), "cuped-fit"), list(by))
    else:
        row = fit.select(F.struct("theta", "mean_pre").alias("f")).scalar()
        joined = df.withColumn("_f", row).select("*", "_f.*").drop("_f")
    adjusted = F.col(post) - F.col("theta") * (F.col(pre) - F.col("mean_pre"))
    return joined.withColumn("adjusted", adjusted).drop("theta", "mean_pre")


def cuped_variance_reduction(df: DataFrame, pre: str, post: str, by: Sequence[str] = ()) -> DataFrame:
    """Raw and adjusted variance with the achieved reduction."""
    fit = cuped_fit(df, pre, post, by)
    adjusted = cuped_transform(df, fit, pre, post, by)
    spread = adjusted.groupBy(*by).agg(
        F.var_samp(post).alias("var_raw"), F.var_samp("adjusted").alias("var_adjusted")
    )
    if by:
        joined = spread.join(fit, list(by))
    else:
        joined = spread.withColumn("_f", fit.select(F.struct("*").alias("f")).scalar()).select("*", "_f.*")
    reduction = F.when(F.col("var_raw") > VARIANCE_FLOOR, 1.0 - F.col("var_adjusted") / F.col("var_raw")).otherwise(0.0)
    return joined.select(
        *by, "var_raw", "var_adjusted", reduction.alias("variance_reduction"), "remaining_variance", "rho", "theta"
    )


def cuped_bootstrap_ci(
    df: DataFrame,
    pre: str,
    post: str,
    key: Sequence[str],
    by: Sequence[str] = (),
    replicates: int = 1000,
    confidence: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Bootstrap interval of the variance reduction, refitted per replicate."""
    means = df.groupBy(*by).agg(F.avg(pre).alias("_mx"), F.avg(post).alias("_my"))
    if by:
        centred = df.join(sized(means, "cuped-means"), list(by))
    else:
        centred = df.withColumn("_m", means.select(F.struct("*").alias("m")).scalar()).select("*", "_m.*")
    x, y = F.col(pre) - F.col("_mx"), F.col(post) - F.col("_my")
    stats = {"w": F.lit(1.0), "wx": x, "wy": y, "wxx": x * x, "wxy": x * y, "wyy": y * y}
    sums = bootstrap_sums(centred, stats, key, by, replicates, seed)
    w = F.col("w")
    sxx = F.col("wxx") - F.try_divide(F.col("wx") * F.col("wx"), w)
    sxy = F.col("wxy") - F.try_divide(F.col("wx") * F.col("wy"), w)
    syy = F.col("wyy") - F.try_divide(F.col("wy") * F.col("wy"), w)
    usable = (F.try_divide(sxx, w - 1) >= VARIANCE_FLOOR) & (F.try_divide(syy, w - 1) > VARIANCE_FLOOR) & (w > 1)
    # With a refitted coefficient the removed share of variance is r squared.
    reduction = F.when(usable, F.try_divide(sxy * sxy, sxx * syy)).otherwise(0.0)
    return percentile_interval(sums, reduction, by, confidence, extra=True)


# ---------------------------------------------------------------- sequential


def arm_moments(
    df: DataFrame, metric: str, arm: str, control: str, treatment: str, by: Sequence[str] = ()
) -> DataFrame:
    """Count, mean and variance per arm side by side, in one aggregation."""
    aggs = []
    for side, name in (("control", control), ("treatment", treatment)):
        value = F.when(F.col(arm) == name, F.col(metric))
        aggs += [
            F.count(value).alias(f"n_{side}"),
            F.avg(value).alias(f"mean_{side}"),
            F.var_samp(value).alias(f"var_{side}"),
        ]
    return df.groupBy(*by).agg(*aggs)


def msprt(
    moments: DataFrame, tau_sq: float = 1.0, alpha: float = 0.05, pooled_variance: float | None = None
) -> DataFrame:
    """Mixture likelihood ratio, always-valid p-value and stopping decision.

    ``moments`` has the columns of :func:`arm_moments`; other columns are kept.
    The confidence sequence is unbounded (null) below two rows per arm.
    """
    nc, nt = F.col("n_control"), F.col("n_treatment")
    if pooled_variance is not None:
        v = F.lit(max(VARIANCE_FLOOR, float(pooled_variance)))
    else:
        vc, vt = F.col("var_control"), F.col("var_treatment")
        pooled = (
            F.when((nc > 1) & (nt > 1), ((nc - 1) * vc + (nt - 1) * vt) / (nc + nt - 2))
            .when(nc > 1, vc)
            .when(nt > 1, vt)
            .otherwise(1.0)
        )
        v = F.greatest(pooled, F.lit(VARIANCE_FLOOR))
    enough = (nc >= 2) & (nt >= 2)
    rows = moments.withColumn("_v", v).withColumn("_t", F.least(nc, nt).cast("double"))
    vv, t = F.col("_v"), F.col("_t")
    delta = F.when((nc > 0) & (nt > 0), F.col("mean_treatment") - F.col("mean_control")).otherwise(0.0)
    tau = max(VARIANCE_FLOOR, tau_sq)
    rows = rows.withColumn("observed_delta", delta)
    d = F.col("observed_delta")
    wide = vv + t * tau
    log_lambda = 0.5 * (F.ln(vv) - F.ln(wide)) + t * t * tau * d * d / (2.0 * vv * wide)
    clipped = F.least(F.greatest(log_lambda, F.lit(-500.0)), F.lit(500.0))
    rows = rows.withColumn("lambda_ratio", F.when(enough, F.exp(clipped)).otherwise(0.0))
    lam = F.col("lambda_ratio")
    half = F.sqrt((vv / t) * (vv + t * tau_sq) / (vv * tau_sq) * 2.0 * F.ln(F.lit(1.0 / alpha)))
    return rows.select(
        *moments.columns,
        "observed_delta",
        "lambda_ratio",
        F.when(lam > 0, F.least(F.lit(1.0), 1.0 / lam)).otherwise(1.0).alias("p_value"),
        F.when(enough, d - half).alias("cs_lower"),
        F.when(enough, d + half).alias("cs_upper"),
        (lam >= 1.0 / alpha).alias("should_stop"),
    )


def msprt_peeking_curve(
    df: DataFrame,
    metric: str,
    arm: str,
    control: str,
    treatment: str,
    day: str,
    by: Sequence[str] = (),
    tau_sq: float = 1.0,
    alpha: float = 0.05,
) -> DataFrame:
    """The test result as of every day.

    Days are summed first; the cumulative window sees one row per experiment
    and day, not one per observation.
    """
    aggs = []
    for side, name in (("control", control), ("treatment", treatment)):
        value = F.when(F.col(arm) == name, F.col(metric))
        aggs += [
            F.count(value).alias(f"_n_{side}"),
            F.coalesce(F.sum(value), F.lit(0.0)).alias(f"_s_{side}"),
            F.coalesce(F.sum(value * value), F.lit(0.0)).alias(f"_q_{side}"),
        ]
    daily = df.groupBy(*by, day).agg(*aggs)
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    sums = daily.select(*by, day, *[F.sum(c).over(upto).alias(c) for c in daily.columns if c.startswith("_")])
    moments = sums
    for side in ("control", "treatment"):
        n, s, q = (F.col(f"_{k}_{side}") for k in "nsq")
        spread = F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)
        moments = (
            moments.withColumn(f"n_{side}", n)
            .withColumn(f"mean_{side}", F.when(n > 0, s / n))
            .withColumn(f"var_{side}", F.when(n > 1, spread))
        )
    moments = moments.drop(*[c for c in daily.columns if c.startswith("_")])
    return msprt(moments, tau_sq, alpha)


# ---------------------------------------------------------------- planning


def required_sample_size(
    baselines: DataFrame,
    mde: Column | float,
    alpha: float = 0.05,
    power: float = 0.80,
    mean: str = "baseline_mean",
    std: str = "baseline_std",
    rho: Column | float = DEFAULT_RHO,
) -> DataFrame:
    """Two-sample z-test size per group, raw and CUPED-adjusted.

    Baselines that are not positive have no size.
    """
    if not (0 < alpha < 1 and 0 < power < 1):
        raise ValueError("alpha and power must be in (0, 1)")
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    share = F.lit(mde) if isinstance(mde, (int, float)) else mde
    r = F.lit(float(rho)) if isinstance(rho, (int, float)) else rho
    delta = share * F.col(mean)
    valid = (F.col(mean) > 0) & (F.col(std) > 0) & (share > 0)
    raw = F.when(valid, F.ceil(F.lit(z * z * 2.0) * F.col(std) * F.col(std) / (delta * delta)))
    sized = baselines.withColumn("mde_relative", share).withColumn("mde_absolute", delta)
    sized = sized.withColumn("n_per_group_raw", raw)
    cuped = F.greatest(F.lit(1), F.ceil(F.col("n_per_group_raw") * F.greatest(1.0 - r * r, F.lit(0.0))))
    sized = sized.withColumn("n_per_group_cuped", F.when(F.col("n_per_group_raw").isNotNull(), cuped))
    return (
        sized.withColumn("n_total_raw", F.col("n_per_group_raw") * 2)
        .withColumn("n_total_cuped", F.col("n_per_group_cuped") * 2)
        .withColumn("cuped_reduction_pct", (1.0 - F.col("n_total_cuped") / F.col("n_total_raw")) * 100.0)
    )


def mde_table(
    baselines: DataFrame,
    mde_levels: Sequence[float] = (0.03, 0.05, 0.10),
    alpha: float = 0.05,
    power: float = 0.80,
    rho: Column | float = DEFAULT_RHO,
    daily_traffic: str | None = None,
) -> DataFrame:
    """Sample sizes per effect level, with test days where traffic is known."""
    if any(not 0 < m < 1 for m in mde_levels):
        raise ValueError("effect levels must be in (0, 1)")
    grid = explode_values(baselines, "_mde", sorted(float(m) for m in mde_levels))
    sized = required_sample_size(grid, F.col("_mde"), alpha, power, rho=rho)
    sized = sized.withColumn("mde_pct", F.bround(F.col("_mde") * 100, 1)).drop("_mde")
    for kind in ("raw", "cuped"):
        days = F.lit(None).cast("bigint")
        if daily_traffic:
            traffic = F.col(daily_traffic)
            days = F.when(traffic > 0, F.ceil(F.col(f"n_total_{kind}") / traffic))
        sized = sized.withColumn(f"experiment_days_{kind}", days)
    return sized


def experiment_report(
    assigned: DataFrame,
    pre: str,
    post: str,
    expected: Mapping[str, float],
    control: str,
    treatment: str,
    by: Sequence[str],
    min_samples: int = 1000,
    tau_sq: float = 1.0,
    alpha: float = 0.05,
    srm_alpha: float = 0.01,
) -> DataFrame:
    """Sample-ratio check, CUPED and sequential test in one row per experiment.

    Everything follows from first and second moments per arm, so the report is
    a single aggregation over the units; adjusted means and variances come from
    the moments instead of a second pass.
    """
    aggs = [F.count(F.when(F.col("group") == g, 1)).alias(f"n_{g}") for g in expected]
    aggs += [F.count(F.lit(1)).alias("n_observations"), F.var_samp(pre).alias("_vx"), F.var_samp(post).alias("_vy")]
    aggs += [F.covar_samp(post, pre).alias("_c"), F.avg(pre).alias("_mx")]
    for side, name in (("control", control), ("treatment", treatment)):
        here = F.col("group") == name
        x, y = F.when(here, F.col(pre)), F.when(here, F.col(post))
        aggs += [
            F.count(y).alias(f"_k_{side}"),
            F.avg(x).alias(f"_x_{side}"),
            F.avg(y).alias(f"_y_{side}"),
            F.var_samp(x).alias(f"_vx_{side}"),
            F.var_samp(y).alias(f"_vy_{side}"),
            F.covar_samp(y, x).alias(f"_c_{side}"),
        ]
    sums = assigned.groupBy(*by).agg(*aggs)
    flat = F.coalesce(F.col("_vx"), F.lit(0.0)) < VARIANCE_FLOOR
    sums = sums.withColumn("theta", F.when(flat, F.lit(0.0)).otherwise(F.col("_c") / F.col("_vx")))
    sums = sums.withColumn(
        "rho",
        F.when(flat | (F.sqrt("_vy") <= VARIANCE_FLOOR), F.lit(0.0)).otherwise(
            F.col("_c") / (F.sqrt("_vx") * F.sqrt("_vy"))
        ),
    )
    theta = F.col("theta")
    keep = [*by, "n_observations", *[f"n_{g}" for g in expected], "rho", "theta"]
    moments = sums.select(
        *[F.col(c).alias(f"_keep_{c}") if c in ("n_control", "n_treatment") else F.col(c) for c in keep],
        *[
            c
            for s in ("control", "treatment")
            for c in (
                F.col(f"_k_{s}").alias(f"n_{s}"),
                (F.col(f"_y_{s}") - theta * (F.col(f"_x_{s}") - F.col("_mx"))).alias(f"mean_{s}"),
                (
                    F.col(f"_vy_{s}") + theta * theta * F.col(f"_vx_{s}") - 2.0 * theta * F.col(f"_c_{s}")
                ).alias(f"var_{s}"),
            )
        ],
    )
    tested = msprt(moments, tau_sq, alpha)
    n = sum((_group_count(g) for g in list(expected)[1:]), _group_count(next(iter(expected))))
    chi2, total_ratio = F.lit(0.0), sum(expected.values())
    for g, ratio in expected.items():
        want = n * F.lit(ratio / total_ratio)
        chi2 = chi2 + F.try_divide((_group_count(g) - want) * (_group_count(g) - want), want)
    tested = tested.withColumn("srm_chi2", chi2)
    tested = tested.withColumn("srm_p_value", chi2_sf_udf("srm_chi2", F.lit(float(len(expected) - 1))))
    ready = F.col("n_observations") >= min_samples
    reduction = F.col("rho") * F.col("rho")
    return tested.select(
        *by,
        "n_observations",
        "srm_chi2",
        "srm_p_value",
        (F.col("srm_p_value") >= srm_alpha).alias("srm_passed"),
        "rho",
        reduction.alias("variance_reduction"),
        F.try_divide(F.lit(1.0), 1.0 - reduction).alias("effective_sample_size_multiplier"),
        F.col("mean_control").alias("cuped_control_mean"),
        F.col("mean_treatment").alias("cuped_treatment_mean"),
        F.when(ready, F.lit("sequential_test")).otherwise("collect_more").alias("decision"),
        *[F.when(ready, F.col(c)).alias(c) for c in ("lambda_ratio", "p_value", "observed_delta")],
        *[F.when(ready, F.col(c)).alias(c) for c in ("cs_lower", "cs_upper")],
        F.when(ready, F.col("should_stop")).otherwise(False).alias("significant"),
    )


def _group_count(group: str) -> Column:
    return F.col(f"_keep_n_{group}" if group in ("control", "treatment") else f"n_{group}")
