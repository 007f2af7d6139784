"""Toxicity scores from FTRL-proximal logistic regression.

Features are hashed word n-grams (one and two words) and skip-grams (two words
with one between), present or not, over the whole lower-cased text. Training
runs FTRL-proximal with per-coordinate rates on a bounded sample of labelled
rows; its L1 term leaves few non-zero weights, and only these are broadcast
(at most ``2 ** bits`` of them, 12 bytes each).

FTRL is sequential: the features of the sample are made by many tasks, and one
task trains on these at most ``2 * rows_per_label`` rows.
Null and empty texts have no features and get the bias alone. Ties and
repeated rows change nothing; with no labelled row every score is 0.5; an
empty table gives no rows. Other columns pass through; ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwright.llm import words as W


@dataclass(frozen=True)
class Params:
    """Learning parameters; ``rows_per_label`` bounds the sample."""

    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.01
    rows_per_label: int = 6000
    epochs: int = 8


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs of distinct features, ordered by row."""
    w = W.words(column, W.ALPHANUMERIC, lower=True)
    h, row = w.hashes(), w.row
    index, owner = [h], [row]
    if len(h) > 1:
        same = row[1:] == row[:-1]
        index.append(W.grams(h, 2)[same])
        owner.append(row[1:][same])
    if len(h) > 2:
        same = row[2:] == row[:-2]
        index.append(W.mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[2:] + np.uint64(1))[same])
        owner.append(row[2:][same])
    flat = np.concatenate(index) >> np.uint64(64 - bits)
    pairs = np.unique((np.concatenate(owner).astype(np.uint64) << np.uint64(bits)) | flat)
    return (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """State z and n of FTRL-proximal; the last coordinate is the bias, without L1."""

    def __init__(self, p: Params):
        self.p = p
        self.z, self.n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        p, z = self.p, self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, p.l1)
        w = -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.p.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


class Weights(dict):
    """Non-zero weights by feature index, -1 the bias, with the ``bits`` of the indexes."""

    def __init__(self, weights: dict[int, float], bits: int):
        super().__init__(weights)
        self.bits = bits


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", params: Params | None = None) -> DataFrame:
    """(text, label) of at most ``rows_per_label`` labelled documents for each label, chosen by a hash of the key.

    The choice is made on the labels alone, so only the chosen keys, bounded by that
    parameter, meet the documents, and no text is moved but theirs.
    """
    p = params or Params()
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, 1.2 * p.rows_per_label / n))).otherwise(share)
    near = known.withColumn("h", F.xxhash64(key)).where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) <= share)
    order = F.row_number().over(Window.partitionBy("label").orderBy("h", key))
    chosen = near.withColumn("k", order).where(F.col("k") <= p.rows_per_label).select(key, F.col("label").alias(label))
    return docs.select(key, text).join(F.broadcast(chosen), key).select(text, label)


def _sample(rows: DataFrame, text: str, label: str, p: Params) -> DataFrame:
    """At most ``rows_per_label`` rows of each label, chosen by a hash of the text."""
    labelled = rows.where(F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    share = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, 1.2 * p.rows_per_label / n))).otherwise(share)
    near = labelled.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) <= share)
    order = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return near.dropDuplicates(["label", "h"]).withColumn("k", order).where(F.col("k") <= p.rows_per_label).drop("k")


def fit(rows: DataFrame, text: str = "text", label: str = "toxic", params: Params | None = None) -> Weights:
    """The weights learned from ``rows``."""
    p = params or Params()
    sample = _sample(rows, text, label, p)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                row, index = features(part.column("text"), p.bits)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(index.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("label"), lists], names=["h", "label", "x"])

    def train(sample: pa.Table) -> pa.Table:
        model = Ftrl(p)
        order = np.argsort(sample["h"].to_numpy(), kind="stable")
        labels, x = sample["label"].to_numpy(), sample["x"].combine_chunks()
        at, index = x.offsets.to_numpy(), x.values.to_numpy().astype(np.int64)
        for _ in range(p.epochs):
            for i in order:
                model.learn(index[at[i] : at[i + 1]], labels[i])
        used = np.flatnonzero(model.n)
        w = model.weights(used)
        return pa.table({"at": pa.array(used[w != 0], pa.int64()), "w": w[w != 0]})

    learned = sample.mapInArrow(extract, "h long, label int, x array<int>").groupBy(F.lit("all").alias("part")).applyInArrow(train, "at long, w double")
    return Weights({(-1 if r["at"] == 1 << p.bits else r["at"]): r["w"] for r in learned.collect()}, p.bits)


def score(docs: DataFrame, weights: dict[int, float], text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; one Arrow pass. Plain weights count as those of the default bits."""
    bits = getattr(weights, "bits", Params.bits)
    kept = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(dict(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits)
        for at, w in shared.value.items():
            if at >= 0:
                dense[at] = w
        bias = shared.value.get(-1, 0.0)
        for batch in batches:
            for part in W.slices(batch, text):
                row, index = features(part.column(text), bits)
                total = np.bincount(row, weights=dense[index], minlength=part.num_rows) + bias
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sigmoid(total))], names=[*kept, "score"])

    return docs.select(*kept).mapInArrow(run, schema)
