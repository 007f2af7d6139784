"""Boosted trees on cell sums: the same models as pyspark.ml where all rows are drawn, in few jobs."""

from threading import Barrier

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from spendwright.functions.hashing import standard_normal, unit_interval
from spendwright.operators import boosting as B
from spendwright.operators import uplift as U

OPTIONS = {**U.REGRESSOR, "maxIter": 6, "subsamplingRate": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    """Features of few values, a third with many."""
    df = spark.range(3000).withColumn("a", F.floor(unit_interval(F.col("id"), seed=1) * 20) / 4)
    df = df.withColumn("b", F.floor(unit_interval(F.col("id"), seed=2) * 7)).withColumn("c", standard_normal(F.col("id"), seed=3))
    y = F.sin("a") * 3 + F.col("b") * F.col("a") / 5 + standard_normal(F.col("id"), seed=4)
    return df.withColumn("y", y).withColumn("t", (F.col("y") + F.col("b") > 4).cast("int"))


def test_regression_equals_pyspark_ml(rows):
    model = B.fit_regression(rows, ["a", "b"], "y", OPTIONS)
    assert model.grid.shape == (20, 7)
    assembled = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(rows)
    want = GBTRegressor(featuresCol="f", labelCol="y", **OPTIONS).fit(assembled).transform(assembled)
    got = model.transform(want.withColumnRenamed("prediction", "want")).select("prediction", "want").toPandas()
    assert got.prediction.to_numpy() == pytest.approx(got.want.to_numpy(), rel=1e-9)


def test_classification_equals_pyspark_ml(rows, tmp_path):
    params = {"maxIter": 6, "subsamplingRate": 1.0}
    model = U.UpliftModel(["a", "b"], "t", "y", params, str(tmp_path)).fit(rows, ["x_learner"])
    assembled = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(rows)
    fitted = GBTClassifier(featuresCol="f", labelCol="t", **{**U.CLASSIFIER, **params}).fit(assembled)
    want = fitted.transform(assembled).select("a", "b", vector_to_array("probability")[1].alias("want"))
    got = model._predict(want, "propensity", "got").toPandas()
    assert got.got.to_numpy() == pytest.approx(got.want.to_numpy(), rel=1e-9)


def test_learners_equal_those_of_pyspark_ml(rows, tmp_path, monkeypatch):
    # bins are those of all rows here, of the arm there: few values, so that the arms have the same
    params = {"maxIter": 4, "subsamplingRate": 1.0, "minInstancesPerNode": 1}

    def effects(folder):
        model = U.UpliftModel(["a", "b"], "t2", "y", params, str(tmp_path / folder)).fit(treated)
        return {name: model.predict_cate(treated, name).orderBy("id").toPandas().cate.to_numpy() for name in U.LEARNERS}

    treated = rows.where("a < 2").withColumn("t2", (unit_interval(F.col("id"), seed=9) < 0.4).cast("int"))
    cells = effects("cells")
    monkeypatch.setattr(B, "MOST_CELLS", 1)
    trees = effects("trees")
    for name in U.LEARNERS:
        assert cells[name] == pytest.approx(trees[name], rel=1e-6, abs=1e-9), name


def test_a_fit_takes_few_jobs(spark, rows, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for trees in (3, 30):
        before = set(tracker.getJobIdsForGroup(None))
        U.UpliftModel(["a", "b", "c"], "t", "y", {"maxIter": trees}, str(tmp_path)).fit(rows)
        jobs[trees] = len(set(tracker.getJobIdsForGroup(None)) - before)
    assert jobs[30] <= jobs[3] + 5 < 150


def test_grid_and_draws(rows):
    grid = B.find_grid(rows, ["a", "c"])
    a, c = (np.array(sorted(r[0] for r in rows.select(f).collect())) for f in "ac")
    assert grid.cuts[0] == tuple((x + y) / 2 for x, y in zip(np.unique(a), np.unique(a)[1:]))
    sizes = np.diff(np.concatenate([[0], np.searchsorted(c, grid.cuts[1]), [3000]]))
    assert len(sizes) == 32 and sizes.min() >= 3000 // 32 and sizes.max() <= 3000 // 32 + 1
    cells = rows.select(grid.cell().alias("n")).toPandas().n.to_numpy()
    pdf = rows.toPandas()
    want = np.searchsorted(grid.cuts[0], pdf.a) * 32 + np.searchsorted(grid.cuts[1], pdf.c)
    assert (cells == want).all()
    assert B.find_grid(rows, ["c", "y", "id", "a"]) is None
    drawn = B.draw(np.arange(4000, dtype=np.uint64), 50, 0.8, 42)
    assert drawn.mean() == pytest.approx(0.8, abs=0.005) and abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.06


def test_equal_rows_are_drawn_apart_and_any_partitioning_gives_the_same(rows):
    params = {**OPTIONS, "subsamplingRate": 0.5}
    same = rows.select(F.lit(1.0).alias("a"), F.lit(2.0).alias("y"))
    grid = B.find_grid(same, ["a"])
    counts = np.sum([r.n for r in B.cell_sums(same, grid, "y", params).collect()], axis=0)
    assert (np.abs(counts - 1500) < 150).all() and len(set(counts.tolist())) > 1
    a, b = (B.fit_regression(rows.repartition(n), ["a", "b", "c"], "y", params).cells.orderBy("cell").toPandas().value for n in (1, 7))
    assert a.to_numpy() == pytest.approx(b.to_numpy())


def test_gaps_and_empty_arms_are_errors(rows, tmp_path):
    for bad in (rows.withColumn("a", F.when(F.col("id") != 5, F.col("a"))), rows.where("t = 1")):
        with pytest.raises(Exception):
            U.UpliftModel(["a", "b"], "t", "y", {"maxIter": 2}, str(tmp_path)).fit(bad)
    model = B.fit_regression(rows, ["a"], "y", OPTIONS)
    with pytest.raises(Exception, match="null or NaN"):
        model.transform(rows.withColumn("a", F.lit(float("nan")))).collect()


def test_a_grid_is_made_and_stored_in_few_tasks(spark, rows, tmp_path, monkeypatch):
    # few distinct values need one range, and a stored grid needs no local rows, which start Python workers
    ranges, ordered = [], B.Ordered
    monkeypatch.setattr(B, "Ordered", lambda df, order, by, partitions=None: ranges.append(partitions) or ordered(df, order, by, partitions))
    grid = B.find_grid(rows.withColumn("one", F.lit(1.0)), ["a", "one", "c"])
    assert ranges == [1] and grid.shape == (20, 1, 32)
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    B.save_grid(spark, grid, str(tmp_path / "grid"))
    assert B.load_grid(spark, str(tmp_path / "grid")) == grid


def test_learners_are_judged_side_by_side(rows, tmp_path, monkeypatch):
    model = U.UpliftModel(["a"], "t", "y", {"maxIter": 2}, str(tmp_path)).fit(rows, ["s_learner", "t_learner"])
    alone = [U.uplift_ablation(model, rows, ["id"], 20, [name]).first() for name in ("s_learner", "t_learner")]
    meet, interval = Barrier(2, timeout=60), U.area_interval
    monkeypatch.setattr(U, "area_interval", lambda *args: (meet.wait(), interval(*args))[1])
    both = U.uplift_ablation(model, rows, ["id"], 20, ["s_learner", "t_learner"]).collect()
    assert sorted(both) == sorted(alone)
