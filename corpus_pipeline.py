"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, folder) that returns a DataFrame;
all but the last return the columns of ``documents``. A stage's rows are
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendwright.llm import decontaminate, language_id, near_dedup, packing, substring_dedup  # noqa: E402
from spendwright.sources.session import configure, materialise, sized  # noqa: E402

#: the last stage is a fitted and hash-ordered computation that SQL cannot express
ORACLE_SQL = None


def _aside(docs: DataFrame, results: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns named like a result renamed, and the columns that give them their names back."""
    names = {c: f"_own_{c}" if c in results else c for c in docs.columns}
    return docs.withColumnsRenamed({c: n for c, n in names.items() if c != n}), [F.col(n).alias(c) for c, n in names.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and undecided ones go."""
    configure(spark)
    rows, own = _aside(docs, language_id.RESULT)
    return language_id.identify(rows, language_id.fit(docs)).where("accepted").select(*own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, once. Rows without an id stay."""
    configure(spark)
    classes = near_dedup.near_classes(docs).where("doc_id = class_id or doc_id is null").select("doc_id").distinct()
    kept = docs.join(classes, docs["doc_id"].eqNullSafe(classes["doc_id"]), "left_semi")
    repeated = sized(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    configure(spark)
    rows, own = _aside(docs, substring_dedup.RESULT)
    cut = substring_dedup.remove_repeats(rows)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("cut_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("cut_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": n_chars}).select(*own)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    configure(spark)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    rows, own = _aside(docs, decontaminate.RESULT)
    return decontaminate.find(rows, benchmark).where(F.size("spans") == 0).select(*own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    configure(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
