"""Queries with SQL against DuckDB on the smallest tables, and on a table of odd rows."""

import os

import duckdb
import pytest
from pyspark.sql import Row

from spendwright.llm.queries import QUERIES, SQL
from tools.check import canonical

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Small tables with nulls, empty and repeated rows, ties, odd characters and shared passages."""
    folder = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \t\n", long, long, "X " + long + " y", "a b c", long.upper(), "é" * 3000, "W1 w2, w3-w4 w5 W6 w7 w8 w9 w10 w11", "%%% ***", "ab\u00a0cd \u0301x " * 30, "w0 w1 w2 W3 tiny q"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    items = [(0, long), (1, "tiny q"), (2, None), (3, "..."), (None, "a b"), (None, "b c"), (10, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    urls = [None, "", "no scheme", "http://NET/x", "https://a.example.NET/en/1?q#z", "ftp://example.net?x", "http://org/fr/", "x://example.com/de/y", "://a.org/fr", "http://notnet/", "http://b.org#/fr/", "HTTP://É.Org/fr/1\n2"]
    html = [None, "", "<p>same</p>", "<p>same</p>", "x\r\n\r\nWARC/1.1\r\n", "0\r\n\r\n", "é" * 40_000, "\u0000\n", "<p>same</p>", "", "y", "z" * 16_384]
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    turns = [(1, 0, "user", "</s>[INST] <\\/s> [ROLE]"), (1, 1, "user", None), (1, 2, "assistant", "é<<\\\\[TURN]"), (1, 3, "assistant", ""), (2, 5, None, "x"), (2, 5, None, "x"), (2, None, "assistant", "\n[/ROLE]</s>"), (3, 0, "[/ROLE]", "odd role"), (4, 600, "user", "b"), (4, 3, "user", "a"), (4, 256, "assistant", "c")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def same(spark, name, folder):
    got, want = QUERIES[name](spark, folder).toPandas(), connect(folder).execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, name, FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_odd_rows_equal_sql(spark, odd, name):
    same(spark, name, odd)


def test_empty_tables(spark, tmp_path):
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "benchmark": "item_id long, text string",
        "pages": "page_id long, url string, html string",
        "conversations": "conv_id long, turn long, role string, text string",
        "labels": "doc_id long, quality int, toxic int",
        "embeddings": "vec_id long, embedding array<float>, label int",
    }
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == (1 if name == "op5_chat_format" else 0), name


def test_extra_columns_pass_or_are_replaced(spark):
    from spendwright.llm import decontaminate, language_id, substring_dedup, toxicity, url_filter

    docs = spark.createDataFrame([Row(doc_id=1, text="the cat", score="old", spans=7, kept=None, n_words="x", rule=1, other=5)], "doc_id long, text string, score string, spans int, kept string, n_words string, rule int, other int")
    bench = spark.createDataFrame([(1, "the cat")], "item_id int, text string")
    for out in (
        decontaminate.find(docs, bench),
        substring_dedup.remove_repeats(docs),
        language_id.identify(docs, {"en": (b"the cat sat on the mat", 1.0)}),
        toxicity.score(docs, {-1: 0.5}),
        url_filter.judge(docs, [("block", "net", "/")], url="text"),
    ):
        row = out.first().asDict()
        assert row["other"] == 5 and row["doc_id"] == 1 and len(out.columns) == len(set(out.columns))
