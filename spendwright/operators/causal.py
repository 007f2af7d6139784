"""Average treatment effects by adjusted regression, with refutations."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from spendwright.functions.hashing import standard_normal, unit_interval
from spendwright.functions.tails import normal_two_sided_udf
from spendwright.operators.bootstrap import bootstrap_sums, percentile_interval
from spendwright.operators.ordering import permute_column
from spendwright.sources.session import materialise, sized

# Ship these helpers inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUBSET_SHARE = 0.8
PASS_LEVEL = 0.05


def causal_columns_check(
    df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str] = (), instruments: Sequence[str] = ()
) -> DataFrame:
    """Fail before any job when a needed column is missing."""
    missing = [c for c in (treatment, outcome, *confounders, *instruments) if c not in df.columns]
    if missing:
        raise ValueError(f"data lacks required columns {missing}")
    return df


def solve_normal_equations(gram: np.ndarray, size: int) -> float:
    """The treatment coefficient from the packed cross products.

    Columns are intercept, regressors, treatment, outcome; the treatment is
    the last regressor.
    """
    matrix = np.zeros((size, size))
    for (i, j), v in zip(combinations_with_replacement(range(size), 2), gram):
        matrix[i, j] = matrix[j, i] = v
    beta = np.linalg.lstsq(matrix[:-1, :-1], matrix[:-1, -1], rcond=None)[0]
    return float(beta[-1])


def _treatment_coefficient(size: int):
    @pandas_udf(DoubleType())
    def solve(gram: pd.Series) -> pd.Series:
        return pd.Series(
            [None if g is None else solve_normal_equations(np.asarray(g, float), size) for g in gram], dtype="float64"
        )

    return solve


def _design(df: DataFrame, treatment: str, outcome: str, regressors: Sequence[str], by: Sequence[str]):
    """Standardised regressors and centred treatment and outcome as ``_z`` columns.

    Neither changes the treatment coefficient; both keep the cross products
    well conditioned.
    """
    names = [*regressors, treatment, outcome]
    stats = df.groupBy(*by).agg(
        *[F.avg(n).alias(f"_m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(n).alias(f"_s{i}") for i, n in enumerate(regressors)],
    )
    if by:
        wide = df.join(sized(stats, "design"), list(by))
    else:
        wide = df.withColumn("_t", stats.select(F.struct("*").alias("t")).scalar()).select("*", "_t.*")
    scaled = []
    for i, n in enumerate(names):
        centred = F.col(n).cast("double") - F.col(f"_m{i}")
        scaled.append(F.when(F.col(f"_s{i}") > 0, centred / F.col(f"_s{i}")).otherwise(0.0)
                      if i < len(regressors) else centred)
    columns = [F.lit(1.0), *scaled]
    keep = [c for c in df.columns]
    return wide.select(*keep, *[c.alias(f"_z{i}") for i, c in enumerate(columns)]), len(columns)


def _products(size: int) -> dict[str, Column]:
    return {
        f"g{k}": F.col(f"_z{i}") * F.col(f"_z{j}")
        for k, (i, j) in enumerate(combinations_with_replacement(range(size), 2))
    }


def ate_ols(
    df: DataFrame,
    treatment: str,
    outcome: str,
    confounders: Sequence[str],
    instruments: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Treatment coefficient of the outcome regression, per group.

    The data enters as one aggregate of pairwise products; only that small
    array reaches Python.
    """
    causal_columns_check(df, treatment, outcome, confounders, instruments)
    rows, size = _design(df, treatment, outcome, [*confounders, *instruments], by)
    products = _products(size)
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in products.values()]).alias("gram")
    )
    return sums.select(*by, "n", _treatment_coefficient(size)("gram").alias("ate"))


def ate_bootstrap_ci(
    df: DataFrame,
    treatment: str,
    outcome: str,
    confounders: Sequence[str],
    key: Sequence[str],
    instruments: Sequence[str] = (),
    by: Sequence[str] = (),
    replicates: int = 500,
    confidence: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Bootstrap interval of the treatment coefficient."""
    rows, size = _design(df, treatment, outcome, [*confounders, *instruments], by)
    products = _products(size)
    sums = bootstrap_sums(rows, products, key, by, replicates, seed)
    solved = sums.withColumn("ate", _treatment_coefficient(size)(F.array(*products)))
    return percentile_interval(solved, F.col("ate"), by, confidence)


def refute(
    df: DataFrame,
    method: str,
    treatment: str,
    outcome: str,
    confounders: Sequence[str],
    key: Sequence[str],
    instruments: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """The effect after one refutation: ``(method, new_ate)``."""
    names = [*confounders, *instruments]
    if method == "random_common_cause":
        changed = df.withColumn("_random_cause", standard_normal(*[F.col(k) for k in key], seed=seed))
        fitted = ate_ols(changed, treatment, outcome, [*confounders, "_random_cause"], instruments)
    elif method == "placebo_treatment":
        slim = df.select(*dict.fromkeys([*key, *names, treatment, outcome]))
        fitted = ate_ols(permute_column(slim, treatment, key, seed), treatment, outcome, confounders, instruments)
    elif method == "data_subset":
        kept = df.where(unit_interval(*[F.col(k) for k in key], seed=seed) < SUBSET_SHARE)
        fitted = ate_ols(kept, treatment, outcome, confounders, instruments)
    else:
        raise ValueError(f"unknown refutation method {method!r}")
    return fitted.select(F.lit(method).alias("method"), F.col("ate").alias("new_ate"))


METHODS = ("random_common_cause", "placebo_treatment", "data_subset")


def refutation_pvalue(refuted: DataFrame) -> DataFrame:
    """p-value and verdict from ``(method, new_ate, orig_ate, ci_lower, ci_upper)``.

    The placebo effect is tested against zero, the others against the original
    effect; the bootstrap interval gives the standard error.
    """
    se = (F.col("ci_upper") - F.col("ci_lower")) / 2.0 / 1.96
    se = F.coalesce(se, F.abs("orig_ate") * 0.1 + 1e-9)
    shift = F.when(F.col("method") == "placebo_treatment", F.col("new_ate")).otherwise(
        F.col("new_ate") - F.col("orig_ate")
    )
    tested = refuted.withColumn("pvalue", normal_two_sided_udf(F.abs(shift) / (se + 1e-12)))
    clipped = F.least(F.greatest(F.col("pvalue"), F.lit(0.0)), F.lit(1.0))
    return tested.withColumn("pvalue", clipped).withColumn("passed", F.col("pvalue") > PASS_LEVEL)


def causal_report(
    df: DataFrame,
    treatment: str,
    outcome: str,
    confounders: Sequence[str],
    key: Sequence[str],
    instruments: Sequence[str] = (),
    replicates: int = 500,
    methods: Sequence[str] = METHODS,
) -> DataFrame:
    """Effect, interval and every refutation, one row per refutation."""
    args = (treatment, outcome, confounders)
    # The needed columns are written once; every step below reads them twice.
    names = dict.fromkeys([*key, *confounders, *instruments, treatment, outcome])
    df = materialise(causal_columns_check(df, *args, instruments).select(*names), "causal")
    effect = ate_ols(df, *args, instruments)
    interval = ate_bootstrap_ci(df, *args, key, instruments, replicates=replicates)
    parts = [refute(df, m, *args, key, instruments) for m in methods]
    refuted = parts[0]
    for part in parts[1:]:
        refuted = refuted.unionByName(part)
    # Both sides are single rows; nothing is paired.
    joined = refuted.withColumn("_e", effect.select(F.struct("n", F.col("ate").alias("orig_ate")).alias("e")).scalar())
    joined = joined.withColumn("_c", interval.select(F.struct("ci_lower", "ci_upper").alias("c")).scalar())
    flat = joined.select("method", "new_ate", "_e.*", "_c.*")
    return refutation_pvalue(flat)
