"""Permutation importance and local linear surrogates of Spark ML models."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from spendwright.functions.hashing import standard_normal
from spendwright.operators.ordering import permute_column
from spendwright.sources.session import materialise

# Ship these helpers inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the local surrogate.
PERTURBATIONS = 500
NOISE_SHARE = 0.2
NOISE_FLOOR = 0.01
KERNEL_WIDTH = 0.25
TOP_FEATURES = 10


def permutation_importance(
    model: Model, df: DataFrame, features: Sequence[str], key: Sequence[str], seed: int = 42
) -> DataFrame:
    """Mean absolute change of the prediction when one column is permuted.

    ``model`` is any fitted Spark ML model or pipeline that reads ``features``
    and writes ``prediction``; ``key`` identifies a row.
    """
    names = list(dict.fromkeys([*key, *features]))
    base = model.transform(df.select(*names)).select(*names, F.col("prediction").alias("_base"))
    base = materialise(base, "base-predictions")  # read twice per feature
    result: DataFrame | None = None
    for j, name in enumerate(features):
        shuffled = permute_column(base, name, key, seed + j)
        change = model.transform(shuffled).agg(F.avg(F.abs(F.col("prediction") - F.col("_base"))).alias("mean_abs_shap"))
        one = change.select(F.lit(name).alias("feature"), "mean_abs_shap")
        result = one if result is None else result.unionByName(one)
    return result.orderBy(F.desc("mean_abs_shap"))


def _surrogate_solver(size: int):
    pairs = list(combinations_with_replacement(range(size), 2))

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(gram: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for g, r in zip(gram, right):
            matrix = np.zeros((size, size))
            for (i, j), v in zip(pairs, g):
                matrix[i, j] = matrix[j, i] = v
            out.append(np.linalg.lstsq(matrix, np.asarray(r, float), rcond=None)[0].tolist())
        return pd.Series(out)

    return solve


def local_surrogate(
    model: Model,
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    perturbations: int = PERTURBATIONS,
    seed: int = 42,
    top: int = TOP_FEATURES,
) -> DataFrame:
    """Weighted linear surrogate around every row: its strongest coefficients.

    Each row is exploded into itself and its hash-seeded neighbours, the model
    predicts them in one pass, and weighted cross products per row are summed
    before the shuffle. Only the solved systems reach Python. The surrogate has
    no intercept.
    """
    p = len(features)
    rows = df.select(*key, *[F.col(f).cast("double").alias(f) for f in features if f not in key])
    # Each row grows by the number of neighbours: spread rows before that.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(perturbations))))
    shifts = []
    for j, f in enumerate(features):
        scale = F.greatest(F.abs(f) * NOISE_SHARE, F.lit(NOISE_FLOOR))
        noise = standard_normal(*[F.col(k) for k in key], F.col("_i"), F.lit(j), seed=seed) * scale
        shifts.append(F.when(F.col("_i") == 0, F.lit(0.0)).otherwise(noise).alias(f"_d{j}"))
    moved = rows.select("*", *shifts)
    squared = sum((F.col(f"_d{j}") * F.col(f"_d{j}") for j in range(1, p)), F.col("_d0") * F.col("_d0"))
    width = KERNEL_WIDTH * p**0.5
    moved = moved.select(
        *key,
        *[(F.col(f) + F.col(f"_d{j}")).alias(f) for j, f in enumerate(features)],
        F.exp(-squared / (2.0 * width * width)).alias("_w"),
    )
    scored = model.transform(moved)
    w, y = F.col("_w"), F.col("prediction")
    x = [F.col(f) for f in features]
    sums = scored.groupBy(*key).agg(
        F.array(*[F.sum(w * x[i] * x[j]) for i, j in combinations_with_replacement(range(p), 2)]).alias("_g"),
        F.array(*[F.sum(w * xi * y) for xi in x]).alias("_r"),
    )
    solved = sums.select(*key, _surrogate_solver(p)("_g", "_r").alias("_c"))
    named = solved.select(
        *key,
        F.inline(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col("_c")[j].alias("coefficient")) for j, f in enumerate(features)])
        ),
    )
    order = Window.partitionBy(*key).orderBy(F.desc(F.abs("coefficient")), "feature")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def compare_explanations(importance: DataFrame, surrogates: DataFrame, n_rows: DataFrame, top_n: int = 10) -> DataFrame:
    """Both explanations side by side with their ranks.

    ``n_rows`` is a one-row count of the explained rows; a feature outside a
    row's strongest coefficients counts as zero there.
    """
    if top_n < 1:
        raise ValueError("top_n must be positive")
    n = n_rows.scalar()
    local = surrogates.groupBy("feature").agg((F.sum(F.abs("coefficient")) / F.max(n)).alias("lime_mean_abs"))
    joined = importance.select("feature", F.col("mean_abs_shap").alias("shap_mean_abs")).join(local, "feature", "left")
    joined = joined.withColumn("lime_mean_abs", F.coalesce("lime_mean_abs", F.lit(0.0)))
    # One row per feature of the model.
    everything = Window.partitionBy(F.lit(0))
    ranked = joined.withColumn("shap_rank", F.rank().over(everything.orderBy(F.desc("shap_mean_abs")))).withColumn(
        "lime_rank", F.rank().over(everything.orderBy(F.desc("lime_mean_abs")))
    )
    return ranked.where(F.col("shap_rank") <= top_n).orderBy("shap_rank").limit(top_n)
