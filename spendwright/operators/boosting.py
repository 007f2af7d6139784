"""Gradient-boosted trees fitted on sums per grid cell.

Boosted trees see a row only through the bins of its features, of which there
are few, so all rows of a grid cell move together: with squared or logistic
loss a tree needs of a cell only the count and the label sum of the rows drawn
for it. One pass over the rows adds these up for every cell and tree at once;
boosting then runs on at most ``MOST_CELLS`` cells (times the arms), however
many rows there are. A fitted model is a table of one value per cell.

The method is that of ``pyspark.ml``'s boosted trees (first tree on the labels,
then on the loss's gradients, shrunken by the step; variance impurity; rows
drawn without replacement for each tree). Bins are cut by the values of all rows
and a row is drawn by a hash, so the model is the same for any partitioning.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendwright.operators.ordering import Ordered
from spendwright.sources.session import materialise, sized

# Ship these helpers inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS = 32
MOST_CELLS = MAX_BINS**3
#: The parameters of ``pyspark.ml``'s boosted trees that are known here.
KNOWN = {"maxIter", "maxDepth", "stepSize", "minInstancesPerNode", "subsamplingRate", "seed", "maxBins", "checkpointInterval"}

CELL, ARM = "_cell", "_arm"
_AT_ONCE = 1000
_VALUES_PER_TASK = 50_000
_STEP, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Grid:
    """Ascending cuts per feature; a value goes right of every cut below it."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(c) + 1 for c in self.cuts)

    def cell(self) -> Column:
        """Number of a row's cell; a missing value is an error."""
        number: Column = F.lit(0).cast("long")
        for name, cuts in zip(self.features, self.cuts, strict=True):
            x = F.col(name).cast("double")
            # not a sum of comparisons: of a hundred of them the generated code is too long to be compiled
            place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < x)) if cuts else F.lit(0)
            missing = F.raise_error(F.lit(f"feature {name} is null or NaN")).cast("int")
            number = number * (len(cuts) + 1) + F.when(x.isNull() | F.isnan(x), missing).otherwise(place)
        return number


def find_grid(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> Grid | None:
    """The cuts of each feature; None if the grid has more than ``MOST_CELLS`` cells.

    Few distinct values are all cut apart, many where the running count of rows
    passes a further ``max_bins``-th of them; a cut lies half-way to the next value.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("double").alias("x")) for i, f in enumerate(features)]))
    counted = df.select(pairs.alias("v")).select("v.*").where("x is not null and not isnan(x)").groupBy("f", "x").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "value-counts")
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = Ordered(counted, [F.col("x")], ["f"], min(most, 1 + counted.count() // _VALUES_PER_TASK))
    sizes = sized(ordered.rows.groupBy("f").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("total")), "feature-sizes")
    ranked = ordered.running_sum({"c": F.col("n")}).join(sizes, "f")
    passed = [F.floor(at * max_bins / F.col("total")) for at in (F.col("c"), F.col("c") - F.col("n"))]
    chosen = ranked.where((F.col("c") < F.col("total")) & ((F.col("values") <= max_bins) | (passed[0] > passed[1])))
    lower = sorted((r.f, r.x) for r in chosen.select("f", "x").collect())
    if lower:
        following = ordered.rows.agg(*[F.min(F.when((F.col("f") == f) & (F.col("x") > x), F.col("x"))) for f, x in lower]).first()
        lower = [(f, (x + after) / 2) for (f, x), after in zip(lower, following, strict=True)]
    grid = Grid(tuple(features), tuple(tuple(x for f, x in lower if f == i) for i in range(len(features))))
    return grid if prod(grid.shape) <= MOST_CELLS else None


def draw(hashes: np.ndarray, trees: int, rate: float, seed: int) -> np.ndarray:
    """Which trees draw a row, one line per row hash."""
    z = hashes[:, None] + (np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003 % 2**63))[None] * _STEP
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(round(rate * 2**53))


def cell_sums(
    rows: DataFrame, grid: Grid, label: str, params: Mapping[str, object], arm: str | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """Count and label sum of the rows drawn for each tree, per cell and arm, in one or more lines each.

    A row is drawn by its ``key``, where it has one, else by its content and,
    of equal rows, its number.
    """
    missing = F.raise_error(F.lit(f"label {label} is null or NaN")).cast("double")
    y = F.col(label).cast("double")
    values = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(grid.features)]
    slim = rows.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        grid.cell().alias(CELL),
        (F.col(arm).cast("int") if arm else F.lit(0)).alias(ARM),
        F.when(y.isNull() | F.isnan(y), missing).otherwise(y).alias("y"),
        *([] if key else values),
    )
    if key:
        slim = slim.withColumn("h", F.xxhash64(*[f"_k{i}" for i in range(len(key))]))
    else:
        counted = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("_n"))
        numbered = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        slim = numbered.withColumn("h", F.xxhash64(*slim.columns, "_copy"))
    # Rows of a cell lie together, so that few lines are written; a crowded cell is split.
    slim = slim.select(CELL, ARM, "y", "h").hint("rebalance", CELL, ARM).sortWithinPartitions(CELL, ARM, "h")
    trees, rate, seed = params["maxIter"], params["subsamplingRate"], params["seed"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, side, y, h = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for at in range(0, len(cell), _AT_ONCE):
                part = slice(at, at + _AT_ONCE)
                c, a = cell[part], side[part]
                first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (a[1:] != a[:-1])]))
                drawn = draw(h[part].view(np.uint64), trees, rate, seed)
                n = np.add.reduceat(drawn, first, axis=0, dtype=np.int32)
                s = np.add.reduceat(drawn * y[part][:, None], first, axis=0)
                ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * trees)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1))) for v in (n, s)]
                yield pa.RecordBatch.from_arrays([pa.array(c[first]), pa.array(a[first]), *lists], names=[CELL, ARM, "n", "s"])

    return slim.mapInArrow(add, f"{CELL} long, {ARM} int, n array<int>, s array<double>")


def _tree(n: np.ndarray, s: np.ndarray, bins: Sequence[np.ndarray], at: np.ndarray, shape: Sequence[int], depth: int, least: int) -> np.ndarray:
    """Value of every grid cell in the regression tree of counts ``n`` and sums ``s`` of the cells ``at``."""
    node = np.zeros(len(bins[0]), dtype=np.int64)
    for level in range(depth):
        nodes, gains = 1 << level, []
        own = node[at]
        for b, size in zip(bins, shape, strict=True):
            place = own * size + b[at]
            count, total = (np.bincount(place, v, nodes * size).reshape(nodes, size).cumsum(axis=1) for v in (n, s))
            left, right = count[:, :-1], count[:, -1:] - count[:, :-1]
            ls, rs = total[:, :-1], total[:, -1:] - total[:, :-1]
            whole = total[:, -1:] ** 2 / np.maximum(count[:, -1:], 1)
            gain = ls**2 / np.maximum(left, 1) + rs**2 / np.maximum(right, 1) - whole
            gains.append(np.where((left >= least) & (right >= least) & (gain > 0), gain, 0.0))
        every = np.concatenate(gains, axis=1)
        if not every.size or not every.any():
            break
        best = every.argmax(axis=1)
        split = every[np.arange(nodes), best] > 0
        first = np.concatenate([[0], np.cumsum([size - 1 for size in shape])])
        feature = np.searchsorted(first, best, side="right") - 1
        border = np.where(split, best - first[feature], np.iinfo(np.int64).max)
        goes_right = np.zeros(len(node), dtype=bool)
        for f, b in enumerate(bins):
            mine = (feature == f)[node]
            goes_right |= mine & (b > border[node])
        node = node * 2 + goes_right
    leaves = 1 << depth
    count, total = (np.bincount(node[at], v, leaves) for v in (n, s))
    return (total / np.maximum(count, 1))[node]


def boost(
    shape: Sequence[int], at: np.ndarray, n: np.ndarray, s: np.ndarray, params: Mapping[str, object], logistic: bool = False
) -> np.ndarray:
    """Prediction for every cell of a grid.

    ``n`` and ``s`` hold, per cell of ``at`` and tree, the drawn rows and their
    label sum; with ``logistic`` loss labels are 0 and 1 and the prediction is
    half the log odds.
    """
    bins = np.unravel_index(np.arange(prod(shape)), shape)
    value = np.zeros(prod(shape))
    for tree in range(params["maxIter"]):
        count, total, f = n[:, tree].astype(float), s[:, tree], value[at]
        if logistic:
            ones, zeros = total, count - total
            odds = np.exp(np.clip(2 * f, -700, 700))
            left = ones - zeros if tree == 0 else 4 * ones / (1 + odds) - 4 * zeros * odds / (1 + odds)
        else:
            left = total if tree == 0 else 2 * (total - count * f)
        step = 1.0 if tree == 0 else params["stepSize"]
        value += step * _tree(count, left, bins, at, shape, params["maxDepth"], params["minInstancesPerNode"])
    return value


def boost_cells(
    sums: DataFrame,
    shape: Sequence[int],
    params: Mapping[str, object],
    cell: Column | None = None,
    logistic: bool = False,
    offset: DataFrame | None = None,
    sign: int = 1,
) -> DataFrame:
    """One row per grid cell with its prediction, from :func:`cell_sums`.

    ``offset`` is a model's cells: labels are then the difference to its
    prediction, times ``sign``. The sums, bounded by the grid, meet in one task.
    """
    lines = sums.select((F.col(CELL) if cell is None else cell).alias(CELL), "n", "s", F.lit(0.0).alias("o"))
    if offset is not None:
        moved = F.broadcast(offset.select(F.col("cell").alias(CELL), F.col("value").alias("o")))
        lines = lines.drop("o").join(moved, CELL).select(CELL, "n", "s", "o")
    trees = params["maxIter"]

    def fit(table: pa.Table) -> pa.Table:
        cells, line = np.unique(table[CELL].to_numpy(), return_inverse=True)
        n, s = np.zeros((len(cells), trees), dtype=np.int32), np.zeros((len(cells), trees))
        end = 0
        for batch in table.to_batches(max_chunksize=1000):
            begin, end = end, end + len(batch)
            count, total = (batch[c].flatten().to_numpy().reshape(len(batch), trees) for c in ("n", "s"))
            np.add.at(n, line[begin:end], count)
            np.add.at(s, line[begin:end], sign * (total - count * batch["o"].to_numpy()[:, None]))
        value = boost(shape, cells, n, s, params, logistic)
        return pa.table({"cell": pa.array(np.arange(len(value), dtype=np.int64)), "value": pa.array(value)})

    return lines.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fit, "cell long, value double")


def look_up(df: DataFrame, cells: DataFrame, cell: Column, column: str) -> DataFrame:
    """``df`` with the prediction of each row's cell; the table of cells has a fixed bound and is broadcast."""
    table = F.broadcast(cells.select(F.col("cell").alias("_at"), F.col("value").alias(column)))
    return df.withColumn("_at", cell).join(table, "_at", "left").drop("_at")


@dataclass
class CellModel:
    """A fitted model that adds ``prediction``."""

    grid: Grid
    cells: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        return look_up(df, self.cells, self.grid.cell(), "prediction")


def fit_regression(
    rows: DataFrame, features: Sequence[str], label: str, params: Mapping[str, object], key: Sequence[str] = ()
) -> CellModel | None:
    """Boosted trees with squared loss; None if the features have too many cells."""
    grid = find_grid(rows, features, params.get("maxBins", MAX_BINS))
    if grid is None:
        return None
    sums = materialise(cell_sums(rows, grid, label, params, key=key), "cell-sums")
    if sums.isEmpty():
        raise ValueError("boosted trees need rows")
    return CellModel(grid, materialise(boost_cells(sums, grid.shape, params), "cell-values"))


def save_grid(spark: SparkSession, grid: Grid, path: str) -> None:
    # literals, not local rows: these would start Python workers
    lines = [
        F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.array(*[F.lit(float(x)) for x in c]).cast("array<double>").alias("cuts"))
        for i, (f, c) in enumerate(zip(grid.features, grid.cuts, strict=True))
    ]
    spark.range(1).coalesce(1).select(F.inline(F.array(*lines))).write.parquet(path)


def load_grid(spark: SparkSession, path: str) -> Grid:
    lines = sorted(spark.read.parquet(path).collect())
    return Grid(tuple(r.feature for r in lines), tuple(tuple(r.cuts) for r in lines))
