"""Fixed parameter grids and rounding helpers.

A grid is exploded from a literal array, so pairing rows with grid points is a
row-local map and needs no join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linspace(low: float, high: float, points: int) -> list[float]:
    """Evenly spaced values including both ends."""
    if points == 1:
        return [float(low)]
    step = (high - low) / (points - 1)
    return [low + step * i for i in range(points - 1)] + [float(high)]


def explode_values(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """One copy of every row per value, the value in column ``name``."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def explode_records(df: DataFrame, records: Iterable[Mapping]) -> DataFrame:
    """One copy of every row per record, the record's fields as columns."""

    def value(v) -> Column:
        return F.lit(None).cast("string") if v is None else F.lit(v)

    structs = [F.struct(*[value(v).alias(k) for k, v in r.items()]) for r in records]
    return df.select("*", F.inline(F.array(*structs)))


def digits_of(col: Column, digits: int | None) -> Column:
    """Half-even rounding, or the column itself when ``digits`` is None."""
    return col if digits is None else F.bround(col, digits)


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` where ``den`` is positive, else ``default``."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))
