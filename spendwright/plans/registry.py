"""Registration of named queries with their result columns and check SQL.

A query lists its result columns once. The list shapes the Spark result and
wraps the check SQL, so names, types and rounding agree on both sides:
``name`` as is, ``name:4`` double rounded to 4 digits, ``name:i`` bigint,
``name:s`` string, ``name:d`` date, ``name:b`` boolean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendwright.sources.views import Tables, with_views

_NUDGE = 1e-9  # keeps exact decimal ties from rounding apart in two engines


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    check_sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.select(*[_shape(name, kind) for name, kind in self.columns])


REGISTRY: dict[str, Query] = {}


def _shape(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.isdigit():
        return (F.round(c.cast("double") + F.lit(_NUDGE), int(kind)) + F.lit(0.0)).alias(name)
    types = {"i": "bigint", "s": "string", "d": "date", "b": "boolean"}
    return c.cast(types[kind]).alias(name) if kind else c


def _shape_sql(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind.isdigit():
        return f"round(CAST({q} AS DOUBLE) + CAST({_NUDGE!r} AS DOUBLE), {kind}) + CAST(0 AS DOUBLE) AS {q}"
    types = {"i": "BIGINT", "s": "VARCHAR", "d": "DATE", "b": "BOOLEAN"}
    return f"CAST({q} AS {types[kind]}) AS {q}" if kind else q


def query(name: str, columns: str, views: str = "", sql: str | None = None):
    """Register a function of :class:`Tables` as the query ``name``."""
    cols = tuple((c.partition(":")[0], c.partition(":")[2]) for c in columns.split())

    def register(build: Callable[[Tables], DataFrame]):
        check = None
        if sql is not None:
            shaped = ", ".join(_shape_sql(n, k) for n, k in cols)
            check = f"SELECT {shaped} FROM (\n{with_views(views, sql)}\n) AS result"
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(build, cols, check)
        return build

    return register
