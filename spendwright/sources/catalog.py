"""Named tables of a session: registration, metadata, counts, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """Make every frame a temp view; an earlier view of the name is replaced."""
    for name, df in tables.items():
        if not name or not name.strip():
            raise ValueError("a table needs a name")
        if not isinstance(df, DataFrame):
            raise TypeError(f"table {name!r} is not a DataFrame")
        df.createOrReplaceTempView(name)
    return sorted(tables)


def table_names(spark: SparkSession) -> list[str]:
    """Names of all tables the session can see."""
    return sorted(t.name for t in spark.catalog.listTables())


def table_info(spark: SparkSession, name: str) -> list[dict]:
    """Position, name, type and nullability of a table's columns."""
    if name not in table_names(spark):
        raise KeyError(f"unknown table {name!r}; known: {table_names(spark)}")
    columns = spark.catalog.listColumns(name)
    return [{"cid": i, "name": c.name, "type": c.dataType, "nullable": c.nullable} for i, c in enumerate(columns)]


def columns_frame(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Non-null values per column next to its type, for all tables.

    One aggregate per table; a table's own plan prunes nothing but reads once.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        facts = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(c).alias("column_name"),
                    F.lit(t).alias("column_type"),
                    F.col(c).alias("non_null"),
                )
                for i, (c, t) in enumerate(df.dtypes)
            ]
        )
        return counts.select(F.lit(name).alias("table_name"), F.inline(facts))

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, all tables in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _plain(c: Column, kind: T.DataType) -> Column:
    """A value as text that any engine can form in the same way; null stays null.

    Fractions are split exactly into whole numbers: the integer part and twice
    52 binary digits (both zeros are one). Times are microseconds, dates days since 1970.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        size = F.abs(c.cast("double"))
        first = (size - F.floor(size)) * F.lit(2.0**52)
        second = (first - F.floor(first)) * F.lit(2.0**52)
        digits = F.concat_ws("_", F.floor(size), F.floor(first), F.floor(second))
        # Beyond 2^62, nearer to zero than 2^-50, infinite or NaN: the name Spark gives the number.
        plain = (size < F.lit(2.0**62)) & ((size >= F.lit(2.0**-50)) | (size == 0))
        text = F.when(plain, digits).otherwise(size.cast("string"))
        return F.concat(F.when(c < 0, "-").otherwise(""), text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("string")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda e: _framed(e, kind.elementType)), "")
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.concat(*[_framed(c[f.name], f.dataType) for f in kind.fields], F.lit("")))
    if isinstance(kind, T.MapType):
        pair = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        entries = F.transform(F.map_entries(c), lambda e: _plain(e, pair))
        return F.array_join(F.transform(F.array_sort(entries), lambda e: _framed(e, T.StringType())), "")
    return c.cast("string")


def _framed(c: Column, kind: T.DataType) -> Column:
    """Bytes, colon, text: no two rows share an encoding by chance of their separators. A null is one letter."""
    text = _plain(c, kind)
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("n"))


def table_fingerprint(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A content fingerprint per table that ignores row order.

    A row's digest is the SHA-256 of its encoded columns. Reported are the
    sums of its first four words of 32 bits, joined by a hyphen, the
    exclusive-or of its first 60 bits, and the rows: equal for shuffled input,
    different once a cell, or the number of equal rows, changes.
    """

    def word(start: int, digits: int) -> Column:
        return F.conv(F.substring("h", start, digits), 16, 10).cast("bigint")

    def one(name: str, df: DataFrame) -> DataFrame:
        row = F.concat(F.lit(""), *[_framed(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
        sums = [F.sum(word(1 + 8 * i, 8).cast("decimal(20,0)")).cast("string") for i in range(4)]
        return df.select(F.sha2(row.cast("binary"), 256).alias("h")).agg(
            F.count(F.lit(1)).alias("row_count"),
            # A table without rows has no sums: the text is empty.
            F.concat_ws("-", *sums).alias("hash_sum"),
            F.bit_xor(word(1, 15)).alias("hash_xor"),
        ).select(F.lit(name).alias("table_name"), "*")

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])
