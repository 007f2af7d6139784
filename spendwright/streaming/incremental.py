"""Incremental forms of the sequential test, drift monitor, snapshot and audit.

Each function turns a streaming DataFrame into a streaming DataFrame; `drain`
runs one over everything available and lands each micro-batch in the shared
folder. Results equal the batch operators over the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spendwright.operators.drift import CONSECUTIVE_DAYS, MAPE_THRESHOLD
from spendwright.operators.experiment import arm_moments, msprt
from spendwright.sources.session import new_path
from spendwright.streaming.keyed import KeyedTable

# Ship these helpers inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = "batch_id"


def drain(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Process all available input; the written micro-batches as a DataFrame.

    A micro-batch overwrites its own folder, so one that is repeated after a
    failure leaves the same result.
    """
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")

    landed = []

    def land(batch: DataFrame, batch_id: int) -> None:
        landed.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField(BATCH, T.LongType())])
    if not landed:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upsert(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Process all available input of an update-mode stream into a new table with one row per key.

    A micro-batch rewrites only the buckets of its keys. To go on with a table
    in a later session, keep a :class:`KeyedTable` and its checkpoint.
    """
    spark = stream.sparkSession
    table = KeyedTable(spark, new_path(spark, label), stream.schema, keys)
    table.absorb(stream, new_path(spark, f"{label}-checkpoint"))
    return table.rows()


def table_glob(folder: str, name: str) -> str:
    """A pattern that matches one table of a folder, be it a file or a folder of files.

    A stream's base path must be a folder unless it is a pattern.
    """
    return f"{folder.rstrip('/')}/{{{name}}}"


def latest_batch(landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last landed row per key (results of update mode)."""
    rest = [c for c in landed.columns if c not in (*keys, BATCH)]
    newest = landed.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row"))
    return newest.select(*keys, "_row.*")


def parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, file_filter: str | None = None,
                   files_per_batch: int | None = None) -> DataFrame:
    """A file stream over Parquet files."""
    reader = spark.readStream.schema(schema)
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


# ---------------------------------------------------------------- sequential test


def drop_repeats(stream: DataFrame, event_id: str, horizon: str | None = None) -> DataFrame:
    """The first arrival of every event id.

    Without a horizon the state store keeps every id for ever. With one (an
    interval such as ``"7 days"``) an id is forgotten that long after it
    arrived, so state is bounded by the ids of one horizon. The clock is the
    arrival, not the time in the row: a row is never late, however old it is.
    A repeat that arrives after the horizon counts again.
    """
    if horizon is None:
        return stream.dropDuplicates([event_id])
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
    return arrived.dropDuplicatesWithinWatermark([event_id]).drop("_arrived")


def stream_msprt(
    observations: DataFrame,
    metric: str,
    arm: str,
    control: str,
    treatment: str,
    by: Sequence[str],
    event_id: str | None = None,
    tau_sq: float = 1.0,
    alpha: float = 0.05,
    horizon: str | None = None,
) -> DataFrame:
    """The sequential test after every micro-batch, one row per experiment.

    State is the built-in count, mean and variance per arm. With an event id,
    repeats are dropped first: those that arrive within the horizon, or
    without one, however far apart they arrive (see :func:`drop_repeats`).
    """
    rows = drop_repeats(observations, event_id, horizon) if event_id else observations
    return msprt(arm_moments(rows, metric, arm, control, treatment, by), tau_sq, alpha)


# ---------------------------------------------------------------- concept drift


_PIECES = T.StructType(
    [
        T.StructField("at", T.ArrayType(T.LongType())),
        T.StructField("length", T.ArrayType(T.LongType())),
        T.StructField("low", T.ArrayType(T.BooleanType())),
        T.StructField("reset", T.ArrayType(T.BooleanType())),
        T.StructField("recent", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)


def _pieces(at: np.ndarray, errors: np.ndarray, reset: np.ndarray, threshold: float, keep: int) -> dict:
    """Rows summed up per time: count, any error that is not high, any reset, the ``keep`` largest errors."""
    order = np.lexsort((-errors, at))  # missing errors last
    at, errors, reset = at[order], errors[order], reset[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    ends = np.r_[starts[1:], len(at)]
    lows, resets = np.logical_or.reduceat(~(errors > threshold), starts), np.logical_or.reduceat(reset, starts)
    return {
        int(at[s]): (int(e - s), bool(low), bool(cleared), errors[s : min(e, s + keep)].tolist())
        for s, e, low, cleared in zip(starts, ends, lows, resets)
    }


def _join_times(one: tuple, other: tuple, keep: int) -> tuple:
    """Summaries of the same time, in either order."""
    errors = np.array([*one[3], *other[3]])
    return (one[0] + other[0], one[1] or other[1], one[2] or other[2], errors[np.argsort(-errors)][:keep].tolist())


def _fold(pieces: dict, keep: int) -> tuple[int, int, bool, list[float]]:
    """Length since the last reset, trailing run of high errors, whether there was a reset, and the last errors, newest first."""
    length = run = 0
    cleared, broken, recent = False, False, []
    for at in sorted(pieces, reverse=True):
        n, low, cleared, errors = pieces[at]
        length += n
        broken = broken or low
        run += 0 if broken else n
        recent += errors[: keep - len(recent)]
        if cleared:
            break
    return length, run, cleared, recent


class _ErrorSpan(StatefulProcessor):
    """Summary of a model's checks in one span of time, from checks in any order."""

    def __init__(self, model: str, threshold: float, keep: int):
        self.model, self.threshold, self.keep = model, threshold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pieces", _PIECES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = {}
        if self.state.exists():
            at, *facts = self.state.get()
            pieces = {int(a): (int(n), low, cleared, list(e)) for a, n, low, cleared, e in zip(at, *facts)}
        for part in rows:
            new = _pieces(
                part["at_micros"].to_numpy(dtype=np.int64),
                part["error"].to_numpy(dtype=float),
                part["cleared"].to_numpy(dtype=bool),
                self.threshold,
                self.keep,
            )
            for at, piece in new.items():
                pieces[at] = _join_times(pieces[at], piece, self.keep) if at in pieces else piece
        times = sorted(pieces)
        self.state.update((times, *[[pieces[at][i] for at in times] for i in range(4)]))
        length, run, cleared, recent = _fold(pieces, self.keep)
        yield pd.DataFrame(
            {
                self.model: [key[0]],
                "span": [key[1]],
                "length": [length],
                "run": [run],
                "reset": [cleared],
                "recent": [recent],
            }
        )

    def close(self) -> None:
        pass


_NO_TIME = -(2**62)


def stream_error_spans(
    checks: DataFrame,
    model: str = "model_id",
    ts: str = "ds",
    threshold: float = MAPE_THRESHOLD,
    consecutive_days: int = CONSECUTIVE_DAYS,
    reset_before: str | None = None,
    span: str = "day",
) -> DataFrame:
    """Error runs per model and span of time, updated in place whatever the order the checks arrive in.

    A span's summary (length, trailing run, reset, last errors) joins with
    that of the next span like a sum, so spans are kept apart: a late check
    changes its own span only, and the checks of one model are shared between
    tasks by span. State is one entry per distinct time of a span; choose a
    span (a unit of ``date_trunc``) with few thousand of them. Checks without
    a time are one span before all others. An error that is null or NaN is
    not high. Of checks at the same time one that is not high ends the run,
    as in the batch operator.
    """
    at = F.col(ts).cast("timestamp")
    start = F.coalesce(F.unix_micros(F.date_trunc(span, at)), F.lit(_NO_TIME))
    cleared = F.coalesce(F.col(reset_before), F.lit(False)) if reset_before else F.lit(False)
    rows = checks.select(
        F.col(model),
        start.alias("span"),
        F.coalesce(F.unix_micros(at), F.lit(_NO_TIME)).alias("at_micros"),
        F.coalesce(F.col("mape").cast("double"), F.lit(float("nan"))).alias("error"),
        cleared.alias("cleared"),
    )
    schema = T.StructType(
        [
            checks.schema[model],
            T.StructField("span", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("run", T.LongType()),
            T.StructField("reset", T.BooleanType()),
            T.StructField("recent", T.ArrayType(T.DoubleType())),
        ]
    )
    processor = _ErrorSpan(model, threshold, consecutive_days)
    return rows.groupBy(model, "span").transformWithStateInPandas(processor, schema, "Update", "None")


def error_run_verdict(spans: DataFrame, model: str = "model_id", consecutive_days: int = CONSECUTIVE_DAYS) -> DataFrame:
    """The verdict per model from its spans (the keyed table of :func:`stream_error_spans`).

    One window over a model's spans, newest first, and one aggregation on the
    same partitioning.
    """
    newer = Window.partitionBy(model).orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.select(
        "*",
        F.coalesce(F.sum("length").over(newer), F.lit(0)).alias("_newer"),
        F.coalesce(F.bool_or(F.col("run") < F.col("length")).over(newer), F.lit(False)).alias("_broken"),
        F.coalesce(F.bool_or("reset").over(newer), F.lit(False)).alias("_cleared"),
    ).where(~F.col("_cleared"))
    near = F.collect_list(F.when(F.col("_newer") < consecutive_days, F.struct(-F.col("span"), "recent")))
    last = F.slice(F.flatten(F.transform(F.array_sort("_near"), lambda s: s["recent"])), 1, consecutive_days)
    known = F.filter("_last", lambda e: e.isNotNull() & ~F.isnan(e))
    total = F.aggregate(known, F.lit(0.0), lambda a, e: a + e)
    per_model = seen.groupBy(model).agg(
        F.sum(F.when(F.col("_broken"), 0).otherwise(F.col("run"))).alias("consecutive_count"),
        F.sum("length").alias("history_length"),
        near.alias("_near"),
    )
    n = F.col("consecutive_count")
    return per_model.withColumn("_last", last).select(
        model,
        F.when(F.size(known) > 0, total / F.size(known)).alias("statistic"),
        "consecutive_count",
        "history_length",
        (n >= consecutive_days).alias("is_drifted"),
        F.when(n >= consecutive_days, "AUTO_RETRAIN").when(n > 0, "ALERT").otherwise("OK").alias("action"),
    )


def stream_concept_drift(
    checks: DataFrame,
    model: str = "model_id",
    ts: str = "ds",
    threshold: float = MAPE_THRESHOLD,
    consecutive_days: int = CONSECUTIVE_DAYS,
    reset_before: str | None = None,
    span: str = "day",
) -> DataFrame:
    """The error-run verdict per model after all available checks, in whatever order they arrive."""
    spans = stream_error_spans(checks, model, ts, threshold, consecutive_days, reset_before, span)
    return error_run_verdict(upsert(spans, [model, "span"], "error-spans"), model, consecutive_days)


# ---------------------------------------------------------------- snapshot


def stream_latest_snapshot(features: DataFrame, key: str = "unique_id", ts: str = "ds") -> DataFrame:
    """The newest feature row per series; land it with :func:`upsert`."""
    rest = [c for c in features.columns if c != key]
    newest = features.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_row"))
    return newest.select(key, "_row.*")


# ---------------------------------------------------------------- audit


def json_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A file stream over JSON-lines files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def stream_audit_stats(log: DataFrame) -> DataFrame:
    """Entries per outcome and action so far."""
    return log.groupBy("outcome", "action").agg(F.count(F.lit(1)).alias("entries"))
