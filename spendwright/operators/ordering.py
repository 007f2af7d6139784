"""Global order at scale: running totals, exact quantiles, permutations.

A window without partitions, or with one hot partition, would put all rows
into one task. Here rows are range-partitioned in the requested order, the
partition number is written down with them, and running totals are taken
inside each range and shifted by the totals of the ranges before it. Writing
the ranges to the shared folder fixes their borders: a lost executor cannot
move a row to another range between the passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendwright.functions.hashing import HASH_BITS, hash_order
from spendwright.sources.session import materialise, sized

RANGE = "_range"


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Ordered:
    """Rows of a DataFrame in a fixed order, split into ranges of similar size.

    ``by`` are group columns, ``order`` the columns (with direction) that order
    rows inside a group. Order the rows uniquely: rows that tie on everything
    share a range.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), partitions: int | None = None):
        self.by = list(by)
        self.order = list(order)
        ranged = df.repartitionByRange(_partitions(df, partitions), *[F.col(c) for c in by], *order)
        self.rows = materialise(ranged.withColumn(RANGE, F.spark_partition_id()), "ordered")

    def _running(self, rows: DataFrame, exprs: Mapping[str, Column], agg, merge, keep: Sequence[str]) -> DataFrame:
        groups = [*self.by, RANGE]
        before = Window.partitionBy(*(self.by or [F.lit(0)])).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        per_range = rows.groupBy(*groups).agg(*[agg(e).alias(f"_o_{n}") for n, e in exprs.items()])
        offsets = per_range.select(*groups, *[agg(f"_o_{n}").over(before).alias(f"_o_{n}") for n in exprs])
        inside = Window.partitionBy(*groups).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        windowed = rows.select("*", *[agg(e).over(inside).alias(f"_w_{n}") for n, e in exprs.items()])
        # Offsets hold one row per range (and group border), so this join is
        # small on the right; its keys are also the window's partitioning.
        joined = windowed.join(offsets, groups, "left")
        return joined.select(*keep, *[merge(F.col(f"_w_{n}"), F.col(f"_o_{n}")).alias(n) for n in exprs])

    def running_sum(self, exprs: Mapping[str, Column], rows: DataFrame | None = None) -> DataFrame:
        """Inclusive running sums; ``rows`` may extend this object's rows."""
        rows = self.rows if rows is None else rows
        return self._running(
            rows, exprs, F.sum, lambda w, o: F.coalesce(w, F.lit(0)) + F.coalesce(o, F.lit(0)), rows.columns
        )

    def running_max(self, exprs: Mapping[str, Column], rows: DataFrame | None = None) -> DataFrame:
        """Inclusive running maxima, null until a first non-null value."""
        rows = self.rows if rows is None else rows
        return self._running(rows, exprs, F.max, lambda w, o: F.greatest(w, o), rows.columns)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows per distinct non-null value (and group), with optional extra sums."""
    extra = [F.sum(e).alias(n) for n, e in (sums or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, ...`` per group, one row each.

    Works on distinct values with their counts in global order; no group is
    collected anywhere. Without groups the result is a single row.
    """
    by = list(by)
    ordered = Ordered(value_counts(df, value, by), [F.col(value)], by)
    ranked = ordered.running_sum({"_cum": F.col("n")})
    totals = ordered.rows.groupBy(*by).agg(F.sum("n").alias("_total"))
    if by:
        ranked = ranked.join(sized(totals, "totals"), by)
    else:
        ranked = ranked.withColumn("_total", totals.scalar())
    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.min(F.when(F.col("_cum") > at, F.col(value))).alias(f"_{end}{i}"))
    bounds = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    result = []
    for i, p in enumerate(probs):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        weight = pos - F.floor(pos)
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        result.append((lo + (hi - lo) * weight).alias(f"q{i}"))
    return bounds.select(*by, *result)


def _hash_rank(df: DataFrame, key: Sequence[str], seed: int, keep: Sequence[str], buckets: int) -> DataFrame:
    """Rank rows 0..n-1 by a seeded hash of their key.

    Hashes are uniform, so equal slices of the hash range are balanced by
    construction and their borders need no sampling.
    """
    bits = max(1, math.ceil(math.log2(buckets)))
    h = hash_order(*[F.col(k) for k in key], seed=seed)
    hashed = df.select(*keep, *[k for k in key if k not in keep], h.alias("_h"))
    hashed = hashed.withColumn("_slice", F.shiftright("_h", HASH_BITS - bits))
    counts = hashed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_slice").orderBy("_h", *key)
    ranked = hashed.withColumn("_i", F.row_number().over(inside))
    return ranked.join(offsets, "_slice").select(*keep, (F.col("_o") + F.col("_i") - 1).alias("_rank"))


def permute_column(df: DataFrame, column: str, key: Sequence[str], seed: int, partitions: int | None = None) -> DataFrame:
    """Permute one column's values over all rows: a seeded bijection.

    ``key`` must identify a row. Row ranks under one hash are paired with value
    ranks under another, so the permutation is one shuffle join on the rank.
    """
    buckets = _partitions(df, partitions)
    rest = [c for c in df.columns if c != column]
    rows = _hash_rank(df, key, 2 * seed, rest, buckets)
    donor = df.select(*{*key, column})
    values = _hash_rank(donor, key, 2 * seed + 1, [column], buckets)
    return rows.join(values, "_rank").select(*df.columns)
