"""The row bootstrap: determinism, width, weights, the same draw in three engines."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendwright.functions.hashing import standard_normal
from spendwright.operators import bootstrap
from spendwright.operators.bootstrap import bootstrap_sums, digest_sql, percentile_interval, replicate_weight, replicate_weights, weight_sql


def test_weights_are_poisson_one():
    w = replicate_weights([str(i) for i in range(4000)], 200, 3)
    assert w.shape == (4000, 200)
    assert w.mean() == pytest.approx(1.0, abs=0.01)
    assert w.var() == pytest.approx(1.0, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06


def test_weights_agree_with_spark_and_sql(spark):
    keys = [("a", 1), ("b", -7), ("é", 10**12)]
    want = replicate_weights([f"{x}|{y}" for x, y in keys], 40, 9)
    grid = spark.createDataFrame(keys, "x string, y long").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(39))))
    got = {(r.x, r.r): r.w for r in grid.withColumn("w", replicate_weight(["x", "y"], F.col("r"), 9)).collect()}
    rows = pd.DataFrame(keys, columns=["x", "y"])  # noqa: F841
    digest = digest_sql(["x", "y"], "(r // 16)", 9)
    sql = duckdb.sql(f"SELECT x, r, {weight_sql('d', 'r')} AS w FROM (SELECT x, r, {digest} AS d FROM rows, range(40) AS t(r))").fetchall()
    for i, (x, _) in enumerate(keys):
        assert [got[x, r] for r in range(40)] == want[i].tolist()
    assert {(x, r): w for x, r, w in sql} == got


@pytest.fixture(scope="module")
def normals(spark):
    return spark.range(20000).withColumn("y", standard_normal(F.col("id"), seed=5) * 2 + 10)


def test_interval_width_matches_theory(normals):
    sums = bootstrap_sums(normals, {"w": F.lit(1.0), "s": F.col("y")}, ["id"], replicates=400)
    low, high = percentile_interval(sums, F.col("s") / F.col("w")).first()
    expected = 2 * 1.96 * 2 / np.sqrt(20000)
    assert high - low == pytest.approx(expected, rel=0.2)
    assert low < 10.05 and high > 9.95


def test_same_for_any_partitioning(normals):
    def run(df):
        sums = bootstrap_sums(df, {"w": F.lit(1.0), "s": F.col("y")}, ["id"], replicates=50)
        return [r.s for r in sums.orderBy("replicate").collect()]

    one = run(normals.repartition(1))
    assert one == pytest.approx(run(normals.repartition(8)))
    rows = normals.toPandas()
    assert one == pytest.approx((replicate_weights([str(i) for i in rows.id], 50, 42).T @ rows.y).tolist())


def test_groups_are_separate_and_may_be_null(normals):
    g = F.when(F.col("id") % 2 == 1, "odd")
    df = normals.withColumn("g", g).withColumn("y", F.col("y") + F.col("id") % 2 * 5)
    sums = bootstrap_sums(df, {"w": F.lit(1.0), "s": F.col("y")}, ["id"], ["g"], replicates=100)
    rows = {r.g: r for r in percentile_interval(sums, F.col("s") / F.col("w"), ["g"]).collect()}
    assert rows[None].ci_lower < 10.1 < 14.9 < rows["odd"].ci_upper
    assert rows[None].ci_upper < rows["odd"].ci_lower


def test_matrix_products_are_too_small_for_blas_threads(spark, monkeypatch):
    plain = bootstrap.replicate_weights

    def checked(keys, replicates, seed):
        assert len(keys) * replicates * 2 <= 1 << 18  # OpenBLAS splits larger products among threads
        return plain(keys, replicates, seed)

    monkeypatch.setattr(bootstrap, "replicate_weights", checked)
    rows = spark.range(4000).repartition(1)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        found = bootstrap_sums(rows, {"one": F.lit(1.0), "v": F.col("id")}, ["id"], replicates=1000).orderBy("replicate").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    weights = plain([str(i) for i in range(4000)], 1000, 42)
    assert [r.one for r in found] == weights.sum(axis=0).tolist()
    assert [r.v for r in found] == pytest.approx((weights.T @ np.arange(4000.0)).tolist())
