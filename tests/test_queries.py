"""The registry, and every checked query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from spendwright.plans import load_queries

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_registry_is_consistent():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 120
    for name, q in load_queries().items():
        assert len({c for c, _ in q.columns}) == len(q.columns), name


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "variance_status" in df.columns and df.count() > 0


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    from spendwright.sources.views import BASE_TABLES

    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


# One query per operator family; CHECK_ALL=1 runs every checked query.
SAMPLE = """auuc audit_stats bucket_distribution chi_squared_error_bins contract_check cost_variance data_drift_ks
experiment_report group_mape interleaving_experiment kruskal_wallis make_vs_buy materialize_features mde_table
msprt_peeking_curve ocogs_trend price_elasticity recommend_actions retrain_history row_counts run_suite serving_drift
should_cost_gap stream_audit_stats supplier_performance""".split()
NAMES = sorted(ORACLE) if os.environ.get("CHECK_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    from tools.check import canonical

    got, want = QUERIES[name](spark, FOLDER).toPandas(), db.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
