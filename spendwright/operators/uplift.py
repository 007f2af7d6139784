"""Meta-learners for individual treatment effects and their evaluation."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendwright.operators import boosting as B
from spendwright.operators.bootstrap import REPLICATE, bootstrap_sums, key_text, percentile_interval, replicate_weights
from spendwright.operators.ordering import Ordered, exact_quantiles
from spendwright.sources.session import exists, lasting_dir, materialise, move, new_path

# Ship these helpers inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Default hyper-parameters of the boosted trees.
REGRESSOR = {
    "maxIter": 300,
    "maxDepth": 4,
    "stepSize": 0.05,
    "minInstancesPerNode": 20,
    "subsamplingRate": 0.8,
    "seed": 42,
    "checkpointInterval": 5,
}
CLASSIFIER = {**REGRESSOR, "maxDepth": 3}
FOREST_MIN_INSTANCES = 50

# Expected areas under the uplift curve.
TARGET_AUUC = {"s_learner": 0.62, "t_learner": 0.68, "x_learner": 0.74, "causal_forest": 0.71}
TARGET_TOLERANCE = 0.05

LEARNERS = ("s_learner", "t_learner", "x_learner", "causal_forest")

# The fitted models each learner is made of; learners share those of the arms.
PARTS = {
    "s_learner": ("single",),
    "t_learner": ("treated", "control"),
    "causal_forest": ("treated_forest", "control_forest"),
    "x_learner": ("treated", "control", "propensity", "effect_treated", "effect_control"),
}

_FEATURES = "_features"
_ROWS_PER_TASK = 100_000


def cut_lineage(spark: SparkSession) -> None:
    """Let boosting write its residuals to the shared folder every ``checkpointInterval`` trees.

    A session that was started with ``spark.checkpoint.dir`` has its folder already.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(new_path(spark, "boosting"))


@dataclass
class UpliftModel:
    """Fitted learners that add a ``cate`` column.

    Features whose bins form a grid of bounded size are boosted on sums per cell
    (:mod:`boosting`), all models from one pass over the rows. Others, and rows
    that ``pyspark.ml`` is to judge (gaps, an empty arm, a treatment other than 0
    and 1), go to its boosted trees, which wait for many small jobs.

    The models a learner needs are fitted side by side, each in a driver thread
    and a scheduler pool of its own; one that needs another's predictions waits
    only for that. Fitted models are
    written to ``folder`` under a fingerprint of rows and parameters, and a later
    fit of the same rows, in this session or another, reads them. Where no folder
    is given it is below the shared one, in local mode below the temporary one.
    """

    features: Sequence[str]
    treatment: str = "treatment"
    outcome: str = "outcome"
    params: Mapping[str, object] = field(default_factory=dict)
    folder: str | None = None
    _models: dict[str, object] = field(default_factory=dict)

    def _assemble(self, df: DataFrame, extra: Sequence[str] = (), out: str = _FEATURES) -> DataFrame:
        return VectorAssembler(inputCols=[*self.features, *extra], outputCol=out).transform(df)

    def _regressor(self, label: str, features: str = _FEATURES, **over) -> GBTRegressor:
        return GBTRegressor(featuresCol=features, labelCol=label, **{**REGRESSOR, **self.params, **over})

    def fit(self, df: DataFrame, learners: Sequence[str] = LEARNERS) -> UpliftModel:
        """Fit the named learners."""
        unknown = set(learners) - set(LEARNERS)
        if unknown:
            raise ValueError(f"unknown learners {sorted(unknown)}; available: {list(LEARNERS)}")
        spark = df.sparkSession
        columns = [*self.features, self.treatment, self.outcome]
        # read several times below
        slim = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "units")
        n, regular, folder = self._fingerprint(slim)
        grid = self._grid(slim, folder) if regular and set(self.params) <= B.KNOWN else None
        wanted = dict.fromkeys(p for name in learners for p in PARTS[name])
        for part in wanted:
            if exists(spark, f"{folder}/{part}"):
                self._models[part] = self._load(spark, part, f"{folder}/{part}", grid)
            else:
                self._models.pop(part, None)
        missing = [p for p in wanted if p not in self._models]
        if missing and grid is not None:
            sums = materialise(B.cell_sums(slim, grid, self.outcome, self._options(), self.treatment), "cell-sums")
            self._models |= self._fit_together(sums, missing, folder, grid)
        elif missing:
            cut_lineage(spark)
            # every model reads the assembled rows many times, in as few tasks as they fill
            rows = self._assemble(slim).coalesce(max(1, -(-n // _ROWS_PER_TASK))).persist()
            try:
                self._models |= self._fit_together(rows, missing, folder)
            finally:
                rows.unpersist()
        return self

    def _options(self, part: str = "single") -> dict[str, object]:
        over = {"minInstancesPerNode": FOREST_MIN_INSTANCES} if part.endswith("forest") else {}
        return {**(CLASSIFIER if part == "propensity" else REGRESSOR), **self.params, **over}

    def _grid(self, rows: DataFrame, folder: str) -> B.Grid | None:
        """The grid of these rows, read if it is stored already."""
        spark, path = rows.sparkSession, f"{folder}/grid"
        if not exists(spark, path):
            grid = B.find_grid(rows, self.features, self.params.get("maxBins", B.MAX_BINS))
            if grid is None:
                return None
            made = new_path(spark, "grid")
            B.save_grid(spark, grid, made)
            move(spark, made, path)
        return B.load_grid(spark, path)

    def _load(self, spark: SparkSession, part: str, path: str, grid: B.Grid | None):
        if grid is not None:
            return B.CellModel(grid, spark.read.schema("cell long, value double").parquet(path))
        return (GBTClassificationModel if part == "propensity" else GBTRegressionModel).load(path)

    def _fingerprint(self, rows: DataFrame) -> tuple[int, bool, str]:
        """(rows, whether they are complete and fill both arms, folder of the models that belong to these rows and parameters)."""
        h, t = F.xxhash64(*rows.columns), F.col(self.treatment)
        whole = [F.col(c).isNotNull() & ~F.isnan(c) for c in rows.columns]
        counts = [F.count_if(reduce(and_, whole)), F.count_if(t == 1), F.count_if(t == 0)]
        seen = rows.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)), *counts).first()
        n, ones, zeros = seen[0], seen[4], seen[5]
        regular = n == seen[3] == ones + zeros and ones > 0 and zeros > 0
        said = repr(("cell sums", rows.sparkSession.version, list(seen), rows.columns, sorted(REGRESSOR.items()), sorted(CLASSIFIER.items()), sorted(self.params.items()), FOREST_MIN_INSTANCES))
        base = self.folder or f"{lasting_dir(rows.sparkSession).rstrip('/')}/uplift-models"
        return n, regular, f"{base}/{hashlib.sha256(said.encode()).hexdigest()[:32]}"

    def _fit_together(self, rows: DataFrame, parts: Sequence[str], folder: str, grid: B.Grid | None = None) -> dict[str, object]:
        spark = rows.sparkSession
        started: dict[str, Future] = {}

        def model(part: str):
            return started[part].result() if part in started else self._models[part]

        def run(part: str):
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"boosting-{part}")
            fitted = self._fit_part(part, rows, model, grid)
            path = new_path(spark, "model")
            if grid is not None:
                fitted.write.parquet(path)
            else:
                fitted.save(path)
            move(spark, path, f"{folder}/{part}")
            return fitted if grid is None else self._load(spark, part, f"{folder}/{part}", grid)

        with ThreadPoolExecutor(len(parts)) as pool:
            for part in parts:  # in the order of PARTS, what a part needs is started before it
                started[part] = pool.submit(inheritable_thread_target(spark)(run), part)
            return {part: future.result() for part, future in started.items()}

    def _fit_part(self, part: str, rows: DataFrame, model: Callable[[str], object], grid: B.Grid | None = None):
        """A fitted model; with a grid, its cells from ``rows``, which hold their sums."""
        if grid is not None:
            return self._boost_part(part, rows, model, grid)
        t, y = F.col(self.treatment), F.col(self.outcome)
        if part == "single":
            return self._regressor(self.outcome, "_with_t").fit(self._assemble(rows, [self.treatment], "_with_t"))
        if part == "propensity":
            return GBTClassifier(featuresCol=_FEATURES, labelCol=self.treatment, **self._options(part)).fit(rows)
        arm = rows.where(t == (1 if "treated" in part else 0))
        if part.startswith("effect"):
            other = model("control" if part == "effect_treated" else "treated")
            guessed = other.copy().setPredictionCol("_p").transform(arm)
            gap = y - F.col("_p") if part == "effect_treated" else F.col("_p") - y
            return self._regressor("_d").fit(guessed.select(_FEATURES, gap.alias("_d")))
        over = {"minInstancesPerNode": FOREST_MIN_INSTANCES} if part.endswith("forest") else {}
        return self._regressor(self.outcome, **over).fit(arm)

    def _boost_part(self, part: str, sums: DataFrame, model: Callable[[str], object], grid: B.Grid) -> DataFrame:
        options = self._options(part)
        if part == "single":
            return B.boost_cells(sums, (*grid.shape, 2), options, F.col(B.CELL) * 2 + F.col(B.ARM))
        if part == "propensity":
            labels = F.when(F.col(B.ARM) == 1, F.transform("n", lambda v: v.cast("double")))
            labels = labels.otherwise(F.transform("n", lambda v: F.lit(0.0)))
            return B.boost_cells(sums.withColumn("s", labels), grid.shape, options, logistic=True)
        arm = sums.where(F.col(B.ARM) == (1 if "treated" in part else 0))
        if part.startswith("effect"):
            other, sign = ("control", 1) if part == "effect_treated" else ("treated", -1)
            return B.boost_cells(arm, grid.shape, options, offset=model(other).cells, sign=sign)
        return B.boost_cells(arm, grid.shape, options)

    def _predict(self, df: DataFrame, part: str, column: str, arm: int | None = None) -> DataFrame:
        """``df`` with a part's prediction; the single model is asked for an arm."""
        model = self._models[part]
        if isinstance(model, B.CellModel):
            cell = model.grid.cell()
            out = B.look_up(df, model.cells, cell if arm is None else cell * 2 + arm, column)
            return out.withColumn(column, 1.0 / (1.0 + F.exp(-2.0 * F.col(column)))) if part == "propensity" else out
        extra = [] if arm is None else ["_t"]
        features = f"_x{column}"
        out = self._assemble(df if arm is None else df.withColumn("_t", F.lit(float(arm))), extra, features)
        if part == "propensity":
            out = model.copy().setFeaturesCol(features).setProbabilityCol(column).transform(out)
            return out.withColumn(column, vector_to_array(column)[1]).select(*df.columns, column)
        return model.copy().setFeaturesCol(features).setPredictionCol(column).transform(out).select(*df.columns, column)

    def is_fitted(self, learner: str) -> bool:
        return all(p in self._models for p in PARTS[learner])

    def predict_cate(self, df: DataFrame, learner: str = "x_learner") -> DataFrame:
        """``df`` with the learner's ``cate``."""
        if learner not in LEARNERS:
            raise ValueError(f"unknown learner {learner!r}; available: {list(LEARNERS)}")
        if not self.is_fitted(learner):
            raise RuntimeError(f"learner {learner!r} is not fitted")
        keep = [c for c in df.columns if c != "cate"]
        if learner == "s_learner":
            out = self._predict(self._predict(df, "single", "_p1", 1), "single", "_p0", 0)
            return out.withColumn("cate", F.col("_p1") - F.col("_p0")).select(*keep, "cate")
        one, zero = {"t_learner": PARTS["t_learner"], "causal_forest": PARTS["causal_forest"]}.get(learner, ("effect_treated", "effect_control"))
        out = self._predict(self._predict(df, one, "_p1"), zero, "_p0")
        if learner != "x_learner":
            # a T-learner with large leaves stands in for the forest
            return out.withColumn("cate", F.col("_p1") - F.col("_p0")).select(*keep, "cate")
        g = F.col("_g")
        out = self._predict(out, "propensity", "_g")
        return out.withColumn("cate", g * F.col("_p0") + (1.0 - g) * F.col("_p1")).select(*keep, "cate")


# ---------------------------------------------------------------- evaluation


def rank_units(
    df: DataFrame, key: Sequence[str], treatment: str = "treatment", outcome: str = "outcome", cate: str = "cate"
) -> DataFrame:
    """Units by falling effect (ties by key) with running arm counts and sums.

    The ordered units are written down, so scoring models run once however
    often the ranking is read.
    """
    slim = df.select(
        *key, F.col(cate).alias("cate"), F.col(treatment).cast("int").alias("t"), F.col(outcome).cast("double").alias("y")
    )
    t, y = F.col("t"), F.col("y")
    ordered = Ordered(slim, [F.desc("cate"), *[F.asc(k) for k in key]])
    ranked = ordered.running_sum(
        {"position": F.lit(1), "n_t": t, "n_c": 1 - t, "s_t": t * y, "s_c": (1 - t) * y}
    )
    return ranked.withColumn("n_units", ordered.rows.agg(F.count(F.lit(1))).scalar()).withColumn("uplift", _uplift())


def _uplift() -> Column:
    one = F.lit(1)
    return F.col("s_t") / F.greatest("n_t", one) - F.col("s_c") / F.greatest("n_c", one)


def uplift_curve(
    df: DataFrame, key: Sequence[str], treatment: str = "treatment", outcome: str = "outcome", cate: str = "cate"
) -> DataFrame:
    """Cumulative uplift after each unit, units by falling effect, ties by key."""
    ranked = rank_units(df, key, treatment, outcome, cate)
    return ranked.select(*key, "cate", "position", (F.col("position") / F.col("n_units")).alias("fraction"), "uplift")


def _area(sum_uplift: Column, last_uplift: Column, n: Column, n_t: Column, n_c: Column) -> Column:
    """Trapezoid over the unit fraction, shifted by one half and clipped."""
    raw = (sum_uplift - last_uplift / 2.0) / n
    area = F.least(F.greatest(raw + 0.5, F.lit(0.0)), F.lit(1.0))
    return F.when((n_t == 0) | (n_c == 0), F.lit(0.5)).otherwise(area)


def auuc(
    df: DataFrame, key: Sequence[str], treatment: str = "treatment", outcome: str = "outcome", cate: str = "cate"
) -> DataFrame:
    """Area under the uplift curve, one row."""
    return area_of(rank_units(df, key, treatment, outcome, cate))


def area_of(ranked: DataFrame) -> DataFrame:
    """The area for units ranked by :func:`rank_units`."""
    sums = ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("uplift").alias("su"),
        F.max_by("uplift", "position").alias("lu"),
        F.max("n_t").alias("nt"),
        F.max("n_c").alias("nc"),
    )
    area = _area(F.col("su"), F.col("lu"), F.col("n"), F.col("nt"), F.col("nc"))
    return sums.select(F.col("n").alias("n_units"), area.alias("auuc"))


CHUNK = 50_000
_AT_ONCE = 500


def _copies(w: np.ndarray, y: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Per replicate the sum of an arm's mean after each of a unit's ``w`` copies.

    The mean after copy k is ``(s + k y) / (n + k) = y + (s - n y) / (n + k)``;
    few units have more than two copies.
    """
    shares = (w >= 1) / (n + 1)
    shares += (w >= 2) / (n + 2)
    flat, counts = shares.reshape(-1), n.reshape(-1)
    left = np.flatnonzero(w >= 3)
    k = 3
    while len(left):
        flat[left] += 1 / (counts[left] + k)
        k += 1
        left = left[w.reshape(-1)[left] >= k]
    return np.einsum("ij,ij->j", w, np.broadcast_to(y, w.shape)) + np.einsum("ij,ij->j", s - n * y, shares)


def auuc_bootstrap_ci(
    df: DataFrame,
    key: Sequence[str],
    treatment: str = "treatment",
    outcome: str = "outcome",
    cate: str = "cate",
    replicates: int = 500,
    confidence: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Bootstrap interval of the area under the uplift curve."""
    return area_interval(rank_units(df, key, treatment, outcome, cate), key, replicates, confidence, seed)


def area_interval(
    ranked: DataFrame, key: Sequence[str], replicates: int = 500, confidence: float = 0.95, seed: int = 42, chunk: int = CHUNK
) -> DataFrame:
    """The interval for units ranked by :func:`rank_units`, from the exact ranking.

    A replicate repeats each unit by its weight, at its place, and takes the area of
    that curve. Running counts and sums are vectors over the replicates: each
    chunk of ``chunk`` places adds up its own, the totals of the chunks before
    are carried in, and one scan adds the curve's heights.
    """
    t, y = F.col("t"), F.col("y")
    slim = ranked.select(F.floor((F.col("position") - 1) / chunk).alias("_chunk"), "position", *key, "t", "y")
    slim = materialise(slim, "ranked")
    names = ["nt", "nc", "st", "sc"]
    stats = dict(zip(names, (t, 1 - t, t * y, (1 - t) * y), strict=True))
    sums = materialise(bootstrap_sums(slim, stats, key, ["_chunk"], replicates, seed), "replicate-sums")
    # One row per chunk and replicate.
    before = Window.partitionBy(REPLICATE).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_chunk", REPLICATE, *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(n) for n in names])

    def scan(rows: pa.Table, carried: pa.Table) -> pa.Table:
        order = np.argsort(rows["position"].to_numpy())
        keys = np.array(rows["_text"].to_pylist(), dtype=object)[order]
        arm, value = (rows[c].to_numpy()[order].astype(float)[:, None] for c in ("t", "y"))
        at = np.argsort(carried[REPLICATE].to_numpy())
        nt, nc, st, sc = (carried[n].to_numpy()[at] for n in names)
        # A missing outcome or arm leaves no area.
        height = np.full(replicates, 0.0 if np.isfinite(arm * value).all() else np.nan)
        for first in range(0, len(keys), _AT_ONCE):
            part = slice(first, first + _AT_ONCE)
            w, treated, v = replicate_weights(keys[part], replicates, seed), arm[part, 0] == 1, value[part]
            sides = []
            for on, n, s in ((treated, nt, st), (~treated, nc, sc)):
                # Counts and sums of the arm before its first unit here and after each one.
                counts = np.concatenate([n[None], w[on]])
                sums = np.concatenate([s[None], w[on] * v[on]])
                sides.append((np.cumsum(counts, axis=0, out=counts), np.cumsum(sums, axis=0, out=sums)))
            for on, (n, s), (other_n, other_s), sign in ((treated, *sides, 1.0), (~treated, *sides[::-1], -1.0)):
                own, y1, n0, s0 = w[on], v[on], n[:-1], s[:-1]
                height += sign * _copies(own, y1, n0, s0)
                # The other arm's mean stands still over all copies of a unit.
                stands = other_s / np.maximum(other_n, 1)
                height -= sign * np.einsum("ij,ij->j", own, stands[np.cumsum(~on)[on]])
            (nt, st), (nc, sc) = ((n[-1], s[-1]) for n, s in sides)
        return pa.table({REPLICATE: pa.array(np.arange(replicates), pa.int32()), "su": height})

    groups = slim.withColumn("_text", key_text(key)).select("_chunk", "position", "_text", "t", "y").groupBy("_chunk")
    scanned = groups.cogroup(offsets.groupBy("_chunk")).applyInArrow(scan, f"{REPLICATE} int, su double")
    heights = scanned.groupBy(REPLICATE).agg(F.sum("su").alias("su"))
    per_rep = sums.groupBy(REPLICATE).agg(*[F.sum(n).alias(n) for n in names]).join(heights, REPLICATE)
    last = F.col("st") / F.greatest("nt", F.lit(1.0)) - F.col("sc") / F.greatest("nc", F.lit(1.0))
    n = F.greatest(F.col("nt") + F.col("nc"), F.lit(1.0))
    return percentile_interval(per_rep, _area(F.col("su"), last, n, F.col("nt"), F.col("nc")), (), confidence)


def uplift_ablation(
    model: UpliftModel, df: DataFrame, key: Sequence[str], replicates: int = 500, learners: Sequence[str] = LEARNERS
) -> DataFrame:
    """Area, interval and target of every learner, best first; the learners are ranked and drawn side by side."""

    def judged(name: str) -> DataFrame:
        scored = model.predict_cate(df, name)
        ranked = rank_units(scored, key, model.treatment, model.outcome)
        point, interval = area_of(ranked), area_interval(ranked, key, replicates)
        struct = interval.select(F.struct("ci_lower", "ci_upper").alias("c")).scalar()
        return point.withColumn("_c", struct).select(
            F.lit(name).alias("learner"),
            F.bround("auuc", 4).alias("auuc"),
            F.bround("_c.ci_lower", 4).alias("ci_lower"),
            F.bround("_c.ci_upper", 4).alias("ci_upper"),
            F.bround(F.col("_c.ci_upper") - F.col("_c.ci_lower"), 4).alias("ci_width"),
            F.lit(TARGET_AUUC[name]).alias("target_auuc"),
            (F.abs(F.col("auuc") - TARGET_AUUC[name]) <= TARGET_TOLERANCE).alias("within_target"),
        )

    with ThreadPoolExecutor(max(1, len(learners))) as pool:
        started = [pool.submit(inheritable_thread_target(df.sparkSession)(judged), name) for name in learners]
        return reduce(DataFrame.unionByName, [one.result() for one in started]).orderBy(F.desc("auuc"))


def identify_sensitive(df: DataFrame, threshold: float = 0.3, cate: str = "cate", fixed_model: bool = False) -> DataFrame:
    """Flag units whose effect's lower bound exceeds a threshold.

    The bound comes from the spread of all effects; with a fixed model there
    is no spread and the effect itself is compared.
    """
    if fixed_model:
        return df.withColumn("ci_lower", F.col(cate)).withColumn("is_sensitive", F.col("ci_lower") > threshold)
    quartiles = exact_quantiles(df, cate, [0.25, 0.75])
    iqr = quartiles.select(F.col("q1") - F.col("q0")).scalar()
    lower = F.col(cate) - 1.96 * F.greatest(iqr / 1.35, F.lit(1e-6))
    return df.withColumn("ci_lower", lower).withColumn("is_sensitive", F.col("ci_lower") > threshold)


def treatment_policy(df: DataFrame, cate: str = "cate", threshold: float = 0.10) -> DataFrame:
    """Recommend treatment above a threshold; the mean effect on every row."""
    mean = df.agg(F.avg(cate)).scalar()
    return df.withColumn("treatment_recommended", F.col(cate) > threshold).withColumn("mean_cate", mean)
