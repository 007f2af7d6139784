"""One-pass Poisson bootstrap of single rows, reproducible in SQL.

Resampling rows with replacement gives every row a count that is close to
Poisson(1). Statistics that are functions of sums therefore need only the
weighted sums per replicate. The weight of a row in a replicate is read from
16 bits of ``sha256("key|seed|block")``, sixteen replicates to a block, so it
depends on nothing but (key, replicate, seed): any partitioning, engine or
repeated task draws the same. :func:`weight_sql` is the draw as SQL,
:func:`replicate_weight` as a Spark column.

Each task adds its rows into one small matrix (replicates x statistics) per
group, batch by batch; the matrices are added in one aggregation.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ship these helpers inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPLICATE = "replicate"
PER_DIGEST = 16

# Poisson(1) by 16-bit uniform: a draw from the k-th value on has a weight above k.
_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])
THRESHOLDS = [int(t) for t in np.ceil(_CDF * (1 << 16) - 0.5) if t < 1 << 16]
_WEIGHTS = np.searchsorted(THRESHOLDS, np.arange(1 << 16), side="right").astype(np.uint8)

#: Multiplications in one matrix product: few enough for the cache, and for BLAS not to
#: start threads, which in every worker of an executor at once would only be in each other's way.
_PRODUCT = 1 << 17
_GROUP_BYTES = 64 << 20


def key_text(key: Sequence[str]) -> Column:
    """The text a row is drawn by."""
    return F.concat_ws("|", *[F.col(k).cast("string") for k in key])


def replicate_weights(keys: Sequence[str], replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, one row per key and one column per replicate."""
    ends = [f"|{seed}|{block}".encode() for block in range(-(-replicates // PER_DIGEST))]
    digests = bytearray()
    for key in keys:
        start = sha256(key.encode())
        for end in ends:
            digest = start.copy()
            digest.update(end)
            digests += digest.digest()
    bits = np.frombuffer(digests, dtype=">u2").reshape(len(keys), -1)[:, :replicates]
    return _WEIGHTS[bits].astype(np.float64)


def replicate_weight(key: Sequence[str], replicate: Column, seed: int) -> Column:
    """The same weight as a Spark expression."""
    block = F.floor(replicate / PER_DIGEST).cast("string")
    digest = F.sha2(F.concat(key_text(key), F.lit(f"|{seed}|"), block), 256)
    at = (F.lit(1) + F.pmod(replicate, F.lit(PER_DIGEST)) * 4).cast("int")
    bits = F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int")
    return F.aggregate(F.array(*[F.lit(t) for t in THRESHOLDS]), F.lit(0), lambda n, t: n + (bits >= t).cast("int"))


def weight_sql(digest: str, replicate: str) -> str:
    """The same weight as SQL, from the hexadecimal digest of :func:`digest_sql`."""
    bits = f"CAST('0x' || substr({digest}, CAST(1 + 4 * ({replicate} % {PER_DIGEST}) AS BIGINT), 4) AS INTEGER)"
    return "(" + " + ".join(f"CAST({bits} >= {t} AS INTEGER)" for t in THRESHOLDS) + ")"


def digest_sql(key: Sequence[str], block: str, seed: int) -> str:
    """The digest of a key's block of sixteen replicates as SQL."""
    texts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"sha256(concat_ws('|', {texts}) || '|{seed}|' || {block})"


def bootstrap_sums(
    df: DataFrame,
    stats: Mapping[str, Column],
    key: Sequence[str],
    by: Sequence[str] = (),
    replicates: int = 500,
    seed: int = 42,
) -> DataFrame:
    """Weighted sums of ``stats`` per group and replicate.

    ``key`` must identify a row of a group: repeated keys would be drawn
    together. A null statistic counts as zero.
    """
    by, names = list(by), list(stats)
    slim = df.select(*by, key_text(key).alias("_key"), *[e.cast("double").alias(n) for n, e in stats.items()])
    # Few bytes but many draws: rows are spread, and a group over several tasks, so
    # that a hot one is split; not over all, as each task leaves one matrix per group.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if by:
        slim = slim.repartition(tasks, *by, F.pmod(F.xxhash64("_key"), F.lit(max(4, tasks // 8))))
    else:
        slim = slim.repartition(tasks, "_key")
    most = max(1, _GROUP_BYTES // (8 * replicates * len(names)))
    at_once = max(1, _PRODUCT // (replicates * len(names)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}

        def made() -> pd.DataFrame:
            out = {n: [k[i] for k in totals for _ in range(replicates)] for i, n in enumerate(by)}
            stacked = np.concatenate(list(totals.values()))
            out[REPLICATE] = np.tile(np.arange(replicates), len(totals))
            out.update({n: stacked[:, i] for i, n in enumerate(names)})
            totals.clear()
            return pd.DataFrame(out)

        for batch in batches:
            keys, values = batch["_key"].tolist(), batch[names].to_numpy(dtype=np.float64, na_value=0.0)
            codes = batch.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(batch), dtype=int)
            order = np.argsort(codes, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ():
                group = tuple(None if pd.isna(v) else v for v in batch[by].iloc[rows[0]]) if by else ()
                total = totals.setdefault(group, np.zeros((replicates, len(names))))
                for at in range(0, len(rows), at_once):
                    part = rows[at : at + at_once]
                    total += replicate_weights([keys[i] for i in part], replicates, seed).T @ values[part]
                if len(totals) >= most:
                    yield made()
        if totals:
            yield made()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema] if by else []
    schema = ", ".join([*fields, f"{REPLICATE} int", *[f"`{n}` double" for n in names]])
    partial = slim.mapInPandas(draw, schema)
    return partial.groupBy(*by, REPLICATE).agg(*[F.sum(n).alias(n) for n in names])


def percentile_interval(
    replicates: DataFrame, statistic: Column, by: Sequence[str] = (), confidence: float = 0.95, extra: bool = False
) -> DataFrame:
    """Percentile interval of a statistic over replicates, per group.

    A group has one value per replicate here, so the exact percentile is small.
    """
    tail = (1.0 - confidence) / 2.0
    aggs = [
        F.percentile("_stat", F.lit(tail)).alias("ci_lower"),
        F.percentile("_stat", F.lit(1.0 - tail)).alias("ci_upper"),
    ]
    if extra:
        aggs += [F.percentile("_stat", F.lit(0.5)).alias("median"), F.stddev_samp("_stat").alias("std")]
    return replicates.withColumn("_stat", statistic).groupBy(*by).agg(*aggs)
