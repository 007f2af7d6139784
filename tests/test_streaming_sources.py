"""Streams equal their batch forms; sources and the catalog."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwright.functions.hashing import standard_normal
from spendwright.operators import drift as D
from spendwright.operators import experiment as E
from spendwright.operators import features as X
from spendwright.sources import catalog, files
from spendwright.sources.session import drop_intermediates, materialise, new_path, work_dir
from spendwright.streaming import incremental as S
from spendwright.streaming.keyed import KeyedTable

DAY0 = dt.date(2024, 1, 1)


def _write_batches(df, column, cuts, tmp_path):
    bounds = [None, *cuts, None]
    for i in range(len(bounds) - 1):
        part = df
        if bounds[i] is not None:
            part = part.where(F.col(column) >= bounds[i])
        if bounds[i + 1] is not None:
            part = part.where(F.col(column) < bounds[i + 1])
        part.coalesce(1).write.parquet(f"{tmp_path}/part={i}")
    return f"{tmp_path}/*"


def test_stream_msprt_drops_repeats(spark, tmp_path):
    df = spark.range(600).select(
        "id", F.lit("e").alias("x"), F.when(F.col("id") % 2 == 0, "c").otherwise("t").alias("arm"),
        (standard_normal(F.col("id"), seed=1) + F.col("id") % 2 * 0.4).alias("y"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    repeated = df.unionByName(df.where("id % 10 = 0"))
    path = _write_batches(repeated, "id", [200, 400], tmp_path)
    stream = S.parquet_stream(spark, path, df.schema, files_per_batch=1)
    landed = S.drain(S.stream_msprt(stream, "y", "arm", "c", "t", ["x"], "id"), "update", "m")
    assert landed.select("batch_id").distinct().count() == 3
    got = S.latest_batch(landed, ["x"]).first()
    want = E.msprt(E.arm_moments(df, "y", "arm", "c", "t", ["x"])).first()
    assert (got.n_control, got.n_treatment) == (300, 300)
    assert got.lambda_ratio == pytest.approx(want.lambda_ratio, rel=1e-9)


def test_stream_over_a_table_folder_keeps_late_files(spark, tmp_path):
    df = spark.range(90).select(
        "id", F.lit("e").alias("x"), F.when(F.col("id") % 2 == 0, "c").otherwise("t").alias("arm"),
        F.col("id").cast("double").alias("y"))
    for low in (60, 0, 30):  # the files do not arrive in the order of the rows
        df.where((F.col("id") >= low) & (F.col("id") < low + 30)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/other.parquet")
    stream = S.parquet_stream(spark, S.table_glob(str(tmp_path), "events.parquet"), df.schema, files_per_batch=1)
    landed = S.drain(S.stream_msprt(stream, "y", "arm", "c", "t", ["x"], "id"), "update", "m")
    assert landed.select("batch_id").distinct().count() == 3
    got = S.latest_batch(landed, ["x"]).first()
    assert (got.n_control, got.n_treatment) == (45, 45)


def test_stream_without_input_is_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, DAY0, 1.0)], "unique_id int, ds date, y double")
    (tmp_path / "none").mkdir()

    def stream():
        return S.stream_latest_snapshot(S.parquet_stream(spark, str(tmp_path / "none"), df.schema))

    assert S.drain(stream(), "update", "n").count() == 0
    assert S.upsert(stream(), ["unique_id"], "n").columns == ["unique_id", "ds", "y"]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_stream_concept_drift_in_any_order(spark, tmp_path, order):
    values = {"a": [0.3] * 9, "b": [0.3, 0.1, 0.3] * 3, "c": [0.1] * 9, "n": [0.3] * 4 + [None] + [0.3, 0.4, float("nan"), 0.5]}
    rows = [(m, DAY0 + dt.timedelta(days=i), v, m == "a" and i == 4) for m, vs in values.items() for i, v in enumerate(vs)]
    rows += [("b", DAY0 + dt.timedelta(days=8), 0.2, None), ("a", None, 0.3, False)]
    df = spark.createDataFrame(rows, "model_id string, ds date, mape double, reset boolean")
    for i in order:  # every micro-batch has days of all the history
        part = df.where(F.pmod(F.xxhash64("model_id", "ds", "mape"), F.lit(3)) == i)
        part.coalesce(1).write.parquet(f"{tmp_path}/part={i}")

    def run(reset):
        stream = S.parquet_stream(spark, f"{tmp_path}/*", df.schema, files_per_batch=1)
        return {r.model_id: r for r in S.stream_concept_drift(stream, reset_before=reset).collect()}

    got = run(None)
    for want in D.concept_drift(df).collect():
        assert got[want.model_id].statistic == pytest.approx(want.statistic)
        assert got[want.model_id].asDict() == {**want.asDict(), "statistic": got[want.model_id].statistic}
    cleared = run("reset")["a"]
    assert (cleared.consecutive_count, cleared.history_length, cleared.action) == (5, 5, "ALERT")


def test_error_spans_of_many_times_equal_a_walk(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(f"m{i % 3}", base + dt.timedelta(minutes=int(m)), float(e), bool(r)) for i, (m, e, r) in enumerate(zip(
        rng.permutation(20_000)[:900], rng.choice([0.1, 0.3, 0.4], 900, p=[0.03, 0.5, 0.47]), rng.random(900) < 0.004))]
    df = spark.createDataFrame(rows, "model_id string, ds timestamp, mape double, reset boolean")
    df.repartition(4).write.parquet(f"{tmp_path}/t")
    for reset in (None, "reset"):
        stream = S.parquet_stream(spark, f"{tmp_path}/t", df.schema, files_per_batch=1)
        got = {r.model_id: r for r in S.stream_concept_drift(stream, reset_before=reset).collect()}
        for model in ("m0", "m1", "m2"):
            run, seen = 0, []
            for _, _, error, cleared in sorted((r for r in rows if r[0] == model), key=lambda r: r[1]):
                if reset and cleared:
                    run, seen = 0, []
                run, seen = (run + 1 if error > 0.2 else 0), [*seen, error]
            assert (got[model].consecutive_count, got[model].history_length) == (run, len(seen))
            assert got[model].statistic == pytest.approx(np.mean(seen[-7:]))


def _keyed(spark, path):
    return KeyedTable(spark, str(path), T._parse_datatype_string("id int, v string"), ["id"], buckets=8)


def test_keyed_table_rewrites_only_touched_buckets(spark, tmp_path):
    want = {i: "a" for i in range(200)} | {None: "a"}
    table = _keyed(spark, tmp_path)
    frame = lambda d: spark.createDataFrame(list(d.items()), "id int, v string")
    assert table.rows().count() == 0 and table.lookup(frame({3: ""})).first().v is None
    assert table.merge(frame(want), 0) == list(range(8))
    for version, change in enumerate(({5: "b"}, {5: "c", 900: "c"}, {}, {None: "d", 7: None}), 1):
        before = table.manifest()[0]
        again = _keyed(spark, tmp_path)  # a restarted driver knows the folder only
        touched = again.merge(frame(change), version)
        again.merge(frame(change), version)  # and may repeat its last micro-batch
        assert len(touched) <= len(change)
        assert {b for b, v in again.manifest()[0].items() if before[b] != v} == set(touched)
        want |= change
        assert {r.id: r.v for r in table.rows().collect()} == want
    assert len(table.versions()) == 2
    kept = {f.parent for f in tmp_path.glob("rows/*/*/*.parquet")}
    assert len(kept) <= 8 + 2  # the newest version and what the one before it still needs
    looked = table.lookup(frame({5: "", 77777: "", None: "", 7: ""}))
    assert {r.id: r.v for r in looked.collect()} == {5: "c", 77777: None, None: "d", 7: None}
    assert len(table.lookup(frame({5: ""})).inputFiles()) <= 2
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path), table.schema, ["none"])


def test_keyed_table_goes_on_after_a_restart(spark, tmp_path):
    features = spark.createDataFrame([(u, DAY0 + dt.timedelta(days=i), float(u + i)) for u in range(9) for i in range(6)],
                                     "unique_id int, ds date, y double")
    for i in range(3):
        features.where((F.dayofmonth("ds") - 1) % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={i}")
        # a new table and stream object every time: only the folders go on
        stream = S.stream_latest_snapshot(S.parquet_stream(spark, f"{tmp_path}/in/*", features.schema, files_per_batch=1))
        table = KeyedTable(spark, f"{tmp_path}/table", stream.schema, ["unique_id"], buckets=4)
        table.absorb(stream, f"{tmp_path}/checkpoint")
    assert len(table.versions()) == 2 and max(table.versions()) == 2
    want = X.latest_snapshot(features).select("unique_id", "ds", "y")
    assert sorted(map(tuple, table.rows().select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_snapshot(spark, tmp_path):
    rows = [(u, DAY0 + dt.timedelta(days=i), float(i * u)) for u in (1, 2, 3) for i in range(10 - u)]
    df = spark.createDataFrame(rows, "unique_id int, ds date, y double")
    path = _write_batches(df, "ds", [DAY0 + dt.timedelta(days=4), DAY0 + dt.timedelta(days=8)], tmp_path)
    stream = S.parquet_stream(spark, path, df.schema, files_per_batch=1)
    got = S.upsert(S.stream_latest_snapshot(stream), ["unique_id"], "s")
    assert sorted(map(tuple, got.select("unique_id", "ds", "y").collect())) == sorted(
        map(tuple, X.latest_snapshot(df).select("unique_id", "ds", "y").collect()))


def test_audit_json_batch_and_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1), "u", "r", f"a{i % 2}", "x", "success", "ip", 1.0, {"k": "v"}) for i in range(6)]
    log = spark.createDataFrame(rows, files.AUDIT_SCHEMA)
    files.append_audit(log, str(tmp_path / "log"))
    files.append_audit(log, str(tmp_path / "log"))
    back = files.read_audit(spark, str(tmp_path / "log"))
    assert back.count() == 12 and back.first().details == {"k": "v"}
    stats = S.stream_audit_stats(S.json_stream(spark, str(tmp_path / "log"), files.AUDIT_SCHEMA, 1))
    got = S.latest_batch(S.drain(stats, "update", "a"), ["outcome", "action"])
    assert {r.action: r.entries for r in got.collect()} == {"a0": 6, "a1": 6}


def test_csv_fallback_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    files.write_csv(df, str(tmp_path / "second.csv"))
    assert files.read_csv(spark, str(tmp_path), ["first", "second"], df.schema).collect() == df.collect()
    assert files.read_csv(spark, str(tmp_path), ["second"]).first().id == 1
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path), ["third"])


def _files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().get("numFiles").get().value()


def test_features_prune_by_day(spark, tmp_path):
    rows = [(u, DAY0 + dt.timedelta(days=i), 1.0) for u in range(3) for i in range(4)]
    written = spark.createDataFrame(rows, "unique_id int, ds date, y double")
    files.write_features(written, str(tmp_path / "f"))
    back = files.read_features(spark, str(tmp_path / "f"), written.schema)
    assert sorted(map(tuple, back.select("unique_id", "ds", "y").collect())) == sorted(rows)
    assert _files_read(back) == len(list(tmp_path.glob("f/*/*.parquet"))) >= 4
    cut = X.training_slice(back, [0, 2], DAY0, DAY0)
    assert cut.count() == 2 and _files_read(cut) == len(list(tmp_path.glob("f/ds=2024-01-01/*.parquet")))
    days = spark.createDataFrame([(DAY0, 1), (DAY0 + dt.timedelta(days=3), 5)], "ds date, peak int").where("peak > 2")
    cut = X.training_slice(back, days=days)
    assert {r.ds for r in cut.collect()} == {DAY0 + dt.timedelta(days=3)} and cut.count() == 3
    assert "dynamicpruning" in cut._jdf.queryExecution().executedPlan().toString()


def test_repeats_are_forgotten_after_the_horizon(spark, tmp_path):
    old = dt.datetime(2001, 1, 1)
    for i in range(4):  # every file: 50 new ids, times that go backwards, and a repeat inside the file
        rows = [(f"e{i}-{n % 50}", old - dt.timedelta(days=i)) for n in range(60)]
        spark.createDataFrame(rows, "id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")

    def run(horizon, label):
        stream = S.parquet_stream(spark, f"{tmp_path}/in/*", T._parse_datatype_string("id string, ts timestamp"),
                                  files_per_batch=1)
        writer = S.drop_repeats(stream, "id", horizon).writeStream.format("memory").queryName(label).outputMode("append")
        q = writer.option("checkpointLocation", f"{tmp_path}/{label}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(label).count(), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]

    kept, state = run(None, "for_ever")
    assert kept == 200 and max(state) == 200
    kept, state = run("1 hour", "inside")
    assert kept == 200 and max(state) == 200
    kept, state = run("1 millisecond", "short")
    assert kept == 200 and max(state) < 200  # old rows stay, ids go


def test_catalog(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    catalog.register_tables(spark, {"cat_a": a})
    catalog.register_tables(spark, {"cat_a": a.limit(1)})  # replaces
    assert spark.table("cat_a").count() == 1
    assert "cat_a" in catalog.table_names(spark)
    assert [c["name"] for c in catalog.table_info(spark, "cat_a")] == ["id", "s"]
    assert {r.table_name: r.row_count for r in catalog.row_counts({"a": a, "b": a.limit(0)}).collect()} == {"a": 2, "b": 0}
    assert [r.non_null for r in catalog.columns_frame({"a": a}).orderBy("position").collect()] == [2, 1]
    with pytest.raises(ValueError):
        catalog.register_tables(spark, {"": a})
    with pytest.raises(TypeError):
        catalog.register_tables(spark, {"x": 3})
    with pytest.raises(KeyError):
        catalog.table_info(spark, "missing")


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("v", F.col("id") * 2)
    one, two, other = (catalog.table_fingerprint({"t": d}).first() for d in (
        a, a.orderBy(F.desc("id")).repartition(5), a.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v")))))
    assert one == two and one.hash_sum != other.hash_sum and one.hash_xor != other.hash_xor


def test_fingerprint_tells_cells_apart(spark):
    schema = "a string, b string, d double, l array<double>, s struct<x:int,y:string>, m map<string,int>, t date"
    base = ("x", "yz", 0.1, [1.0, None], (1, "q"), {"k": 1, "j": 2}, DAY0)
    changes = [("xy", "z"), (None, "yz"), ("x", "")]
    rows = [base, *[(*c, *base[2:]) for c in changes]]
    for i, value in ((2, 0.1 + 2e-17), (2, -0.1), (2, float("inf")), (2, float("nan")), (2, 1e300), (2, 0.0), (2, 5e-324), (3, [1.0]),
                     (3, []), (3, None), (4, (1, None)), (4, None), (5, {"k": 1}), (5, {}), (5, None), (6, None)):
        rows.append((*base[:i], value, *base[i + 1 :]))
    frames = {f"t{i}": spark.createDataFrame([r], schema) for i, r in enumerate(rows)}
    frames["twice"] = spark.createDataFrame([base, base], schema)
    got = {r.table_name: r for r in catalog.table_fingerprint({**frames, "none": frames["t0"].limit(0)}).collect()}
    sums = [got[f"t{i}"].hash_sum for i in range(len(rows))]
    assert len(set(sums)) == len(rows)
    assert got["twice"].row_count == 2 and got["twice"].hash_sum not in sums
    assert (got["none"].row_count, got["none"].hash_sum) == (0, "")


def test_work_dir_is_stable_and_materialise_reads_back(spark):
    assert work_dir(spark) == work_dir(spark)
    assert new_path(spark, "a") != new_path(spark, "a")
    df = spark.range(5).withColumn("d", F.lit(DAY0))
    assert materialise(df, "t").exceptAll(df).count() == 0
    assert drop_intermediates(spark) > 0 and drop_intermediates(spark) == 0


def test_parts_of_many_files_are_three_batches(spark):
    from spendwright.plans.streaming_queries import _in_three_parts

    days = F.date_add(F.lit("2024-01-05").cast("date"), (F.col("id") % 4 * 7).cast("int"))
    df = spark.range(400).select((F.col("id") % 90).alias("unique_id"), days.alias("ds"), F.col("id").cast("double").alias("y"))
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path, files = _in_three_parts(df, "unique_id", "many-files")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    assert files > 1
    stream = S.parquet_stream(spark, f"{path}/*", df.schema, files_per_batch=files)
    landed = S.drain(S.stream_latest_snapshot(stream), "update", "many-files")
    assert landed.agg(F.countDistinct(S.BATCH)).first()[0] <= 3
    got = S.latest_batch(landed, ["unique_id"])
    want = df.groupBy("unique_id").agg(F.max("ds").alias("ds"))
    assert got.count() == 90 and got.join(want, ["unique_id", "ds"]).count() == 90
