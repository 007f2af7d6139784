"""Global order primitives against plain windows and numpy."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spendwright.operators.ordering import Ordered, exact_quantiles, permute_column


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, one group holds most rows."""
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 37 % 1000).cast("double")).alias("v"),
        F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("g"),
    )


def test_running_sum_equals_window(skewed):
    got = Ordered(skewed, [F.asc("v"), F.asc("id")], partitions=6).running_sum({"s": F.col("v"), "n": F.lit(1)})
    order = Window.partitionBy(F.lit(0)).orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("id", F.sum("v").over(order).alias("s"), F.count("v").over(order).alias("n"))
    assert got.select("id", "s", "n").exceptAll(want).count() == 0
    assert got.count() == 3000


def test_running_by_group(skewed):
    ordered = Ordered(skewed, [F.desc("v"), F.asc("id")], ["g"], partitions=6)
    got = ordered.running_sum({"n": F.lit(1)})
    got = ordered.running_max({"m": F.when(F.col("v") == 7.0, F.col("n"))}, got)
    order = Window.partitionBy("g").orderBy(F.desc("v"), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("id", "v", F.count("v").over(order).alias("n"), "g")
    want = want.select("id", "n", F.max(F.when(F.col("v") == 7.0, F.col("n"))).over(
        Window.partitionBy("g").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    assert got.select("id", "n", "m").exceptAll(want).count() == 0


def test_hot_value_is_spread_over_ranges(skewed):
    ordered = Ordered(skewed, [F.asc("v"), F.asc("id")], partitions=6)
    sizes = [r["count"] for r in ordered.rows.groupBy("_range").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 3000 / 3


def test_exact_quantiles(skewed):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    values = np.array([r.v for r in skewed.select("v").collect()])
    got = exact_quantiles(skewed, "v", probs).first()
    assert list(got) == pytest.approx(list(np.quantile(values, probs)))


def test_exact_quantiles_by_group(skewed):
    got = {r.g: (r.q0, r.q1) for r in exact_quantiles(skewed, "v", [0.3, 0.75], ["g"]).collect()}
    for g in "ab":
        values = [r.v for r in skewed.where(F.col("g") == g).collect()]
        assert got[g] == pytest.approx(tuple(np.quantile(values, [0.3, 0.75])))


def test_permutation_is_a_bijection(skewed):
    once = permute_column(skewed, "v", ["id"], seed=1, partitions=5)
    rows = {r.id: r.v for r in once.collect()}
    original = {r.id: r.v for r in skewed.collect()}
    assert sorted(rows.values()) == sorted(original.values())
    assert sum(rows[i] != original[i] for i in rows) > 1000
    assert {r.id: r.g for r in once.collect()} == {r.id: r.g for r in skewed.collect()}
    again = {r.id: r.v for r in permute_column(skewed.repartition(3), "v", ["id"], seed=1, partitions=5).collect()}
    assert again == rows
    other = {r.id: r.v for r in permute_column(skewed, "v", ["id"], seed=2, partitions=5).collect()}
    assert other != rows
