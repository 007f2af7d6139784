"""Forecast-error fairness across groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendwright.functions.grids import digits_of
from spendwright.functions.tails import chi2_sf_udf
from spendwright.operators.bootstrap import bootstrap_sums, percentile_interval
from spendwright.operators.ordering import Ordered, exact_quantiles
from spendwright.sources.session import materialise

ERROR_FLOOR = 1.0


def absolute_percentage_error(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """Absolute error over the actual value, which is floored at one unit."""
    return F.abs(F.col(y_true) - F.col(y_pred)) / F.greatest(F.abs(y_true), F.lit(ERROR_FLOOR))


def measured(df: DataFrame, group: str) -> DataFrame:
    """The rows that count: those with a group and a defined error (neither null nor NaN)."""
    error = absolute_percentage_error().cast("double")
    return df.where(F.col(group).isNotNull() & error.isNotNull() & ~F.isnan(error))


def group_mape(df: DataFrame, group: str, digits: int | None = 4) -> DataFrame:
    """Mean absolute percentage error per group, best group first."""
    means = measured(df, group).groupBy(group).agg((F.avg(absolute_percentage_error()) * 100).alias("m"), F.count(F.lit(1)).alias("n_samples"))
    return means.select(group, digits_of(F.col("m"), digits).alias("mape"), "n_samples").orderBy("mape")


def group_mape_ci(
    df: DataFrame, group: str, key: Sequence[str], replicates: int = 1000, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """Group errors with bootstrap intervals, in percent."""
    stats = {"w": F.lit(1.0), "e": absolute_percentage_error()}
    sums = bootstrap_sums(measured(df, group), stats, key, [group], replicates, seed)
    interval = percentile_interval(sums, F.when(F.col("w") > 0, F.col("e") / F.col("w") * 100), [group], confidence)
    return group_mape(df, group).join(interval, group).select(
        group, "mape", F.bround("ci_lower", 4).alias("ci_lower"), F.bround("ci_upper", 4).alias("ci_upper"), "n_samples"
    )


def kruskal_wallis(df: DataFrame, group: str) -> DataFrame:
    """Rank test for equal error distributions, with tie correction.

    Errors are compressed to counts per distinct value; a value's mid-rank
    follows from the running count, so no group is ever sorted in one place.
    """
    counts = measured(df, group).select(F.col(group).alias("g"), absolute_percentage_error().alias("v")).groupBy("v", "g").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = materialise(counts, "error-counts")  # read twice below
    values = counts.groupBy("v").agg(F.sum("n").alias("t"))
    ordered = Ordered(values, [F.col("v")])
    ranked = ordered.running_sum({"_c": F.col("t")})
    mid = F.col("_c") - F.col("t") + (F.col("t") + 1) / 2.0
    ranks = ranked.select("v", mid.alias("rank"))
    per_group = counts.join(ranks, "v").groupBy("g").agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("n"))
    t = F.col("t").cast("double")
    ties = ordered.rows.agg(F.struct(F.sum(t).alias("n"), F.sum(t * t * t - t).alias("ties"))).scalar()
    sums = per_group.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("n_groups"))
    tested = sums.withColumn("_t", ties).select("s", "n_groups", "_t.*")
    n = F.col("n")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)
    h = raw / (1.0 - F.col("ties") / (n * n * n - n))
    checked = F.when(
        F.col("n_groups") < 2, F.raise_error(F.lit("Kruskal-Wallis needs at least 2 groups")).cast("double")
    ).otherwise(h)
    return tested.select(checked.alias("H"), "n_groups").withColumn(
        "p_value", chi2_sf_udf("H", (F.col("n_groups") - 1).cast("double"))
    )


def chi_squared_error_bins(df: DataFrame, category: str, n_error_bins: int = 4) -> DataFrame:
    """Independence of category and error quantile bin.

    Quantiles are exact and linear; equal edges merge. With one degree of
    freedom the continuity correction applies.
    """
    rows = measured(df, category).select(F.col(category).alias("c"), absolute_percentage_error().alias("e"))
    probs = [i / n_error_bins for i in range(n_error_bins + 1)]
    edges = exact_quantiles(rows, "e", probs)
    struct = edges.select(F.struct(*edges.columns).alias("q")).scalar()
    top = F.col(f"q.q{n_error_bins}")
    inner = [F.col(f"q.q{i}") for i in range(1, n_error_bins)]
    # An inner edge equal to the maximum is the outer edge and splits nothing.
    bin_of = reduce(lambda a, q: a + F.when((q <= F.col("e")) & (q < top), 1).otherwise(0), inner, F.lit(0))
    binned = rows.withColumn("q", struct).select("c", bin_of.alias("b"))
    table = binned.groupBy("c").agg(
        *[F.count(F.when(F.col("b") == i, 1)).cast("double").alias(f"o{i}") for i in range(n_error_bins)]
    )
    row_total = reduce(lambda a, i: a + F.col(f"o{i}"), range(1, n_error_bins), F.col("o0"))
    totals = table.agg(
        F.struct(
            F.count(F.lit(1)).alias("k"),
            F.sum(row_total).alias("n"),
            *[F.sum(f"o{i}").alias(f"t{i}") for i in range(n_error_bins)],
        )
    ).scalar()
    cells = table.withColumn("t", totals)
    used = reduce(
        lambda a, i: a + F.when(F.col(f"t.t{i}") > 0, 1).otherwise(0), range(n_error_bins), F.lit(0)
    )
    cells = cells.withColumn("dof", (F.col("t.k") - 1) * (used - 1))

    def cell(i: int) -> Column:
        expected = row_total * F.col(f"t.t{i}") / F.col("t.n")
        gap = F.abs(F.col(f"o{i}") - expected)
        gap = F.when(F.col("dof") == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        return F.when(F.col(f"t.t{i}") > 0, gap * gap / expected).otherwise(0.0)

    terms = reduce(lambda a, i: a + cell(i), range(1, n_error_bins), cell(0))
    result = cells.agg(F.sum(terms).alias("s"), F.max("dof").alias("dof"), F.count(F.lit(1)).alias("n_categories"))
    checked = F.when(
        F.col("n_categories") < 2, F.raise_error(F.lit("the chi-squared test needs at least 2 categories")).cast("double")
    ).otherwise(F.col("s"))
    # One error bin leaves nothing to test.
    p = F.when(F.col("dof") == 0, 1.0).otherwise(chi2_sf_udf("chi2", F.col("dof").cast("double")))
    return result.select(checked.alias("chi2"), "dof", "n_categories").withColumn("p_value", p)


def in_slices(df: DataFrame, slices: Mapping[str, Column]) -> DataFrame:
    """One row per matching named slice; slices may overlap."""
    if not slices:
        raise ValueError("at least one slice is needed")
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in slices.items()]))
    return df.withColumn("segment", F.explode(names))


def slice_fairness(df: DataFrame, slices: Mapping[str, Column], digits: int | None = 4) -> DataFrame:
    """Errors per named slice; a slice without rows has no result."""
    return group_mape(in_slices(df, slices), "segment", digits)


def slice_fairness_ci(
    df: DataFrame, slices: Mapping[str, Column], key: Sequence[str], replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """Slice errors with bootstrap intervals."""
    return group_mape_ci(in_slices(df, slices), "segment", key, replicates, seed=seed)
