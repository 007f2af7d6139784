"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

An entry c of a vector becomes the integer ``floor(SCALE * c) + OFFSET``; the
model is fitted on each distinct integer vector once, so frequent copies carry
no weight. The covariance is never formed. A block of orthonormal directions Q
is improved in rounds:

1. a Chebyshev recurrence in the covariance V, stretched over the unwanted
   part [0, smallest Ritz value of the block] of the spectrum, damps that part;
   each of its steps is one distributed pass that sums ``x (x Q)`` over the
   centred rows,
2. QR makes the block orthonormal again,
3. Rayleigh-Ritz with one more pass gives values, directions and the residual
   ``|V u - e u|`` of each.

The rounds end when every wanted residual is within ``CERTIFIED`` of the largest
value, and a fresh random block, kept orthogonal to what was found, shows no
larger direction that the block has missed.

A pass sums one small matrix per task; the matrices are summed in groups on the
executors before the last few reach the driver, so nothing that is collected
grows faster than the root of the number of tasks. Rows are read from one
written table of distinct vectors, which a lost executor does not take away.

Rows are dropped whose vector is null, empty, holds a null, a NaN, an infinity
or an entry beyond ``LARGEST``, or whose length is not the most common one (the
greater length if two are as common). Repeated rows and null keys are kept, each
as a row. Directions whose eigenvalue is below ``NO_VARIANCE`` of the trace are
rounding noise and left out, so a table of equal vectors has no components. An
empty table gives no rows. Other columns pass through; those named like a result
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwright.sources.session import materialise

SCALE, OFFSET = 64, 1_000_000
#: entries beyond it are not finite in any useful sense, and their integers would leave the exact range of a double
LARGEST = 2.0**40
COMPONENTS = 16
DEGREE, MOST_ROUNDS = 10, 40
CERTIFIED, NO_VARIANCE = 1e-13, 1e-11
RESULT = ("deviation", "whitened")


@dataclass
class Whitening:
    """Eigenpairs of the covariance of the distinct integer vectors, by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def _integers(vector: Column) -> Column:
    """The integers without their offset; null where the vector is not usable."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    fine = (F.size(vector) > 0) & F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return F.when(vector.isNotNull() & fine, F.transform(wide, lambda c: F.floor(c * SCALE)))


def _name(df: DataFrame, label: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while label in taken:
        label += "_"
    return label


def usable(df: DataFrame, vector: str = "embedding", dimensions: int | None = None, out: str = "ints") -> DataFrame:
    """The rows that take part, with their integers (without the offset) as ``out``."""
    rows = df.withColumn(out, _integers(F.col(vector))).where(F.col(out).isNotNull())
    if dimensions is None:
        sizes = rows.groupBy(F.size(out).alias("d")).count()
        most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
        dimensions = most["d"] if most else 0
    return rows.where(F.size(out) == dimensions)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _added(rows: DataFrame, shape: tuple[int, ...], of_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``of_batch(integers)``, an array of ``shape``."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.select("ints").mapInArrow(one, "part binary")
    tasks = rows.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(more, "part binary")
    return sum((np.frombuffer(bytes(r["part"])).reshape(shape) for r in parts.collect()), np.zeros(shape))


def _centred(ints: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return ints.astype(np.float64) - mean


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, seed: int = 7) -> Whitening:
    """The leading eigenpairs of the distinct integer vectors of ``df``."""
    rows = materialise(usable(df.select(vector), vector).select("ints").distinct(), "distinct-vectors")
    per_place = rows.select(F.posexplode("ints").alias("at", "v")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("at").collect()
    if not per_place:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0.0, 0)
    n, sums = int(per_place[0]["n"]), [int(r["s"]) for r in per_place]
    d, mean = len(sums), np.array([s / n for s in sums])
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(ints: np.ndarray) -> np.ndarray:
            x = _centred(ints, mean)
            return x.T @ (x @ q)

        return _added(rows, q.shape, product) / n

    trace = float(_added(rows, (d,), lambda ints: np.square(_centred(ints, mean)).sum(axis=0)).sum()) / n
    if trace == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0, 0.0, 1)
    wanted = min(components, d)
    width = min(d, 3 * components)
    draw = np.random.default_rng(seed)
    q = np.linalg.qr(draw.standard_normal((d, width)))[0]
    best, checked = np.inf, False
    for _ in range(MOST_ROUNDS):
        vq = apply(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max()) / max(values[0], trace / d)
        if width == d or residual <= CERTIFIED or (residual <= 100 * CERTIFIED and residual > best / 2):
            if width == d or checked:
                break
            # a fresh block in what is left: a direction above the wanted ones would have been missed
            checked = True
            fresh = draw.standard_normal((d, min(width, d - wanted)))
            keep = q[:, :wanted]
            fresh = np.linalg.qr(fresh - keep @ (keep.T @ fresh))[0]
            fresh = _damped(apply, fresh, float(values[-1]), DEGREE)
            fresh -= keep @ (keep.T @ fresh)
            q = np.linalg.qr(np.concatenate([keep, fresh], axis=1))[0][:, :width]
            best = np.inf
            continue
        best = min(best, residual)
        q = np.linalg.qr(_damped(apply, q, float(values[-1]), DEGREE))[0]
    real = int((values[:wanted] > NO_VARIANCE * trace).sum())
    values, vectors = values[:real].copy(), q[:, :real].copy()
    project = vectors / np.sqrt(values)

    def outer(ints: np.ndarray) -> np.ndarray:
        z = _centred(ints, mean) @ project
        return np.concatenate([z.T @ z, z.sum(axis=0, keepdims=True)])

    seen = _added(rows, (real + 1, real), outer) / n if real else np.zeros((1, 0))
    error = np.abs(seen[:-1] - np.outer(seen[-1], seen[-1]) - np.eye(real)).max() if real else 0.0
    return Whitening(n, sums, values, vectors, trace, residual, float(error), passes)


def _damped(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, above: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V that is small on [0, ``above``], applied to the block.

    Columns are scaled after each step, which changes no column's direction.
    """
    half = max(above, np.finfo(float).tiny) / 2
    before, now = q, (apply(q) - half * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (apply(now) - half * now) / half - before
        size = np.linalg.norm(now, axis=0)
        size[size == 0] = 1
        before, now = before / size, now / size
    return now


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The usable rows of ``df`` with ``deviation`` and ``whitened``.

    ``deviation`` is the exact sum over the dimensions of ``(n * x - sum)**2``: a
    long, or a decimal where 63 bits may not hold it. ``whitened`` has one number
    per component.
    """
    columns = [c for c in df.columns if c not in RESULT]
    if not model.n:
        return df.select(*columns, F.lit(None).cast("long").alias(RESULT[0]), F.lit(None).cast("array<double>").alias(RESULT[1])).limit(0)
    n, sums, d = model.n, model.sums, len(model.sums)
    mean = np.array([s / n for s in sums])
    project = model.vectors / np.sqrt(model.values) if len(model.values) else np.zeros((d, 0))
    ints = _name(df, "ints")
    rows = usable(df, vector, d, ints)
    far = rows.agg(F.max(F.array_max(F.transform(ints, lambda v: F.abs(v))))).first()[0] or 0
    fits = d * (2 * n * max(int(far), 1)) ** 2 < 2**63
    deviation = T.LongType() if fits else T.DecimalType(38, 0)
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField(RESULT[0], deviation), T.StructField(RESULT[1], T.ArrayType(T.DoubleType()))])
    exact = np.array(sums, dtype=np.int64 if fits else object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(ints))
            far = x.astype(exact.dtype) * n - exact
            squares = (far * far).sum(axis=1)
            kind = pa.int64() if fits else pa.decimal128(38, 0)
            z = _centred(x, mean) @ project
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * z.shape[1])
            arrays = [*[batch.column(c) for c in columns], pa.array(squares.tolist(), kind), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *RESULT])

    return rows.select(*columns, ints).mapInArrow(run, schema)
