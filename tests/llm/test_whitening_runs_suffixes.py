"""Whitening against numpy, periodic runs and byte dedup against brute force, and their odd rows."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from spendwright.llm import periodic, suffix_dedup, toxicity, whitening
from spendwright.llm import words as W
from spendwright.llm.queries import QUERIES
from spendwright.sources import session


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24)) @ np.diag(np.linspace(2, 0.3, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # copies carry no weight
    rows += [(None, rows[5][1]), (2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 22), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2005, [1.0] * 23), (2006, [1e300] * 24)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_whitening_equals_numpy(vectors):
    model = whitening.fit(vectors, components=8)
    out = whitening.whiten(vectors.withColumn("deviation", F.lit("old")).withColumn("ints", F.lit(7)), model).orderBy("vec_id").toPandas()
    assert len(out) == 801 and set(out.ints) == {7} and list(out.columns) == ["vec_id", "embedding", "ints", "deviation", "whitened"]
    x = np.floor(64 * np.stack(out.embedding)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    assert model.n == len(fit) == 600
    values, vectors_ = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors_ = values[::-1][:8], vectors_[:, ::-1][:, :8]
    assert model.values == pytest.approx(values, rel=1e-12)
    assert model.explained == pytest.approx(values / np.trace(np.cov(fit.T, bias=True)), rel=1e-10)
    z = (x - fit.mean(axis=0)) @ vectors_ / np.sqrt(values)
    assert np.abs(np.abs(np.stack(out.whitened)) - np.abs(z)).max() < 1e-8
    assert out.deviation.tolist() == ((600 * x - fit.sum(axis=0)) ** 2).sum(axis=1).tolist()
    assert model.identity_error < 1e-9 and model.residual < 1e-11


def test_whitening_without_variance_or_rows(spark, vectors):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    model = whitening.fit(same)
    assert model.n == 1 and not len(model.values)
    assert [tuple(r) for r in whitening.whiten(same, model).select("deviation", F.size("whitened")).distinct().collect()] == [(0, 0)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert len(whitening.fit(line).values) == 1
    empty = vectors.where("vec_id = 2000")
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0
    far = spark.createDataFrame([(i, [float(2**34 * i)] * 3) for i in range(3)], "vec_id long, embedding array<double>")
    sums = [64 * 2**34 * 3] * 3
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(far, whitening.fit(far)).collect()}
    assert got == {i: sum((3 * 64 * 2**34 * i - s) ** 2 for s in sums) for i in range(3)}


def brute_runs(ws):
    found = {}
    for q in range(len(ws) // 4, 0, -1):  # a smaller period replaces a larger one of the same stretch
        i = 0
        while i + q < len(ws):
            start = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q) and i > start:
                found[start, i - start + q] = q
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_equal_brute_force(spark):
    rng = random.Random(1)
    docs = []
    for _ in range(400):
        ws = [rng.choice("abcde"[: rng.choice([1, 2, 5])]) * rng.choice([1, 1, 9]) for _ in range(rng.randrange(70))]
        if ws and rng.random() < 0.6:
            a, p = rng.randrange(len(ws)), rng.randrange(1, 8)
            ws = [w if i < a else ws[min(a + (i - a) % p, len(ws) - 1)] for i, w in enumerate(ws)]
        docs.append(ws)
    docs += [["x"] * 5, ["x"] * 6, ["é", " b"] * 4, ["long" * 300] * 7, [f"w{i % 900}" for i in range(9000)]]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(d), "old") for i, d in enumerate(docs)] + [(None, None, "old"), (None, "", "old")]
    out = {r.id: r for r in periodic.find_runs(spark.createDataFrame(rows, "id long, text string, runs string")).collect()}
    for i, ws in enumerate(docs):
        want = brute_runs(ws)
        assert [tuple(r) for r in out[i].runs] == want, ws
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert out[i].collapsed == " ".join(w for k, w in enumerate(ws) if k not in gone) and out[i].n_words == len(ws)
    assert out[None].runs == [] and out[None].collapsed == ""


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(W.Words, "hashes", lambda self: np.full(len(self.start), 7, dtype=np.uint64))
    w = W.words(pa.array(["a b a b a b a b c d e f g h", "x x x x x x"]), W.BLANK_SEPARATED)
    assert periodic.runs_of(w) == [(0, 8, 2), (14, 6, 1)]


def brute_bytes(docs):
    first = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        yield bytes(c for c, g in zip(t, gone) if not g), sum(gone), len([r for r in bytes(gone).split(b"\0") if r])


@pytest.mark.parametrize("shard_bytes, hot", [(4 << 20, 20_000), (3000, 20_000), (3000, 2)])
def test_byte_repeats_equal_brute_force(spark, shard_bytes, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 5000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdéfgh") for _ in range(rng.randrange(1, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(10, 80))) for _ in range(5)]
    docs = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randrange(5)):
            b = rng.choice(base)
            x = rng.randrange(len(b))
            parts.append(b[x : rng.randrange(x, len(b) + 1)] + (word() if rng.random() < 0.7 else ""))
        docs.append((rng.randrange(60), "".join(parts)))
    docs += [(100, "a" * 300), (101, "b" + "a" * 120), (102, "\0" * 60), (103, "\0" * 61), (104, base[0] * 40), (104, base[0] * 40), (105, "")]
    rows = spark.createDataFrame([(d, t, k, "old") for k, (d, t) in enumerate(docs)] + [(None, base[1], 900, "old"), (None, base[1], 901, "old"), (106, None, 902, "old")], "doc_id long, text string, k int, kept string")
    out = {r.k: r for r in suffix_dedup.remove_repeats(rows, shard_bytes=shard_bytes, hot=hot).collect()}
    every = [(d, t.encode()) for d, t in docs] + [(2**62, base[1].encode())] * 2 + [(106, b"")]
    keys = [*range(len(docs)), 900, 901, 902]
    for k, (_, t), (kept, removed, spans) in zip(keys, every, brute_bytes(every), strict=True):
        assert (bytes(out[k].kept), out[k].n_removed, out[k].n_spans, out[k].n_bytes) == (kept, removed, spans, len(t))
    assert out[902].text is None and out[0].text == docs[0][1]


def test_byte_repeats_shuffle_texts_once_and_write_nothing_between(spark):
    rows = spark.createDataFrame([(i, f"{i % 7} the same long text, repeated in many of the rows of a table " * 3) for i in range(40)], "doc_id long, text string")
    before = {k: list(v) for k, v in session._CREATED.items()}
    out = suffix_dedup.remove_repeats(rows, keep_text=False, shard_bytes=500)
    out.collect()
    assert {k: list(v) for k, v in session._CREATED.items()} == before
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ReusedExchange") == 2


def test_anchors_are_dealt_evenly_and_lists_keep_their_numbers():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 50_000, dtype=np.uint8).tobytes() for _ in range(4)]
    press = zstandard.ZstdCompressor()
    rows = pa.table({"_deal": pa.array(range(4), pa.int64()), "_doc": pa.array(range(4), pa.int64()), "_body": pa.array([press.compress(t) for t in texts], pa.binary())})
    made = suffix_dedup._anchors(8)((pa.scalar(0),), rows)
    sizes = [len(suffix_dedup._hashes(b)) for b in made.column("hashes").combine_chunks()]
    assert made.column("part").to_pylist() == list(range(8)) and max(sizes) < 1.3 * sum(sizes) / 8
    assert sum(len(b.as_py()) for b in made.column("hashes").combine_chunks()) < 6 * sum(sizes)
    top = np.array([0, 5, 2**48 - 1], dtype=np.uint64)
    assert suffix_dedup._hashes(pa.scalar(suffix_dedup._ascending(top))).tolist() == top.tolist()
    for numbers in (np.array([-1, 2**62], dtype=np.int64), np.zeros(0, dtype=np.int64)):
        assert suffix_dedup._numbers(pa.scalar(suffix_dedup._squeezed(numbers)), np.int64).tolist() == numbers.tolist()


@pytest.mark.parametrize("depth", [8, 50])
def test_suffix_order_equals_sorted_slices(depth):
    text = np.frombuffer(b"abracadabra" * 9 + b"abra" + b"a" * 120, dtype=np.uint8)
    found = [text[i : i + depth].tobytes() for i in suffix_dedup.suffix_order(text, depth)]
    assert found == sorted(text[i : i + depth].tobytes() for i in range(len(text)))


def test_learned_weights_keep_their_bits(spark):
    docs = spark.createDataFrame([(i, "good fine day" if i % 2 else "bad rude word") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int"))
    p = toxicity.Params(bits=12, rows_per_label=30, l1=0.1)
    sample = toxicity.labelled_sample(docs, labels, params=p)
    assert {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()} == {0: 30, 1: 30}
    scored = toxicity.score(docs, toxicity.fit(sample, params=p))
    assert scored.where((F.col("score") > 0.5) != (F.col("doc_id") % 2 == 0)).count() == 0


def test_workers_need_no_installed_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {QUERIES["op1_language_id"].__code__.co_filename.rsplit("/spendwright/", 1)[0]!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from spendwright.llm import periodic, suffix_dedup
docs = spark.createDataFrame([(1, "a " * 40), (2, "a " * 40)], "doc_id long, text string")
print("runs", periodic.find_runs(docs).count(), suffix_dedup.remove_repeats(docs).agg({{"n_removed": "sum"}}).first()[0])
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "runs 2 80" in done.stdout, done.stderr[-2000:]
