"""File sources and sinks with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("user", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_csv(spark: SparkSession, folder: str, names: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The first of ``names`` that exists as a CSV file in ``folder``.

    With a schema nothing is inferred; without one Spark scans for types.
    """
    path_type = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = f"{folder.rstrip('/')}/{name}.csv"
        hadoop_path = path_type(path)
        if hadoop_path.getFileSystem(conf).exists(hadoop_path):
            reader = spark.read.option("header", True)
            reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
            return reader.csv(path)
    raise FileNotFoundError(f"no CSV file for any of {list(names)} in {folder}")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line per file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_audit(log: DataFrame, path: str) -> None:
    """Append audit records as JSON lines."""
    log.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: T.StructType = AUDIT_SCHEMA) -> DataFrame:
    """Audit records from JSON lines."""
    return spark.read.schema(schema).json(path)


def write_features(features: DataFrame, path: str) -> None:
    """Features as Parquet, one folder per day so date ranges prune files.

    The rebalance hint groups a day's rows into few files and splits big days;
    inside a file rows are sorted by series, so the statistics of its row
    groups prune listed ids.
    """
    rows = features.hint("rebalance", "ds").sortWithinPartitions("ds", "unique_id")
    rows.write.mode("overwrite").partitionBy("ds").parquet(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Written features with their declared columns; a condition on the day reads its folders only."""
    return spark.read.schema(schema).parquet(path)
