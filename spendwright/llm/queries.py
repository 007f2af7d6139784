"""The registered queries of this folder, as functions of (spark, folder), and their check SQL.

Each query reads its whole table, applies its operator with production
parameters and derives the columns asked for from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendwright.llm import chat, decontaminate, fingerprints, language_id, near_dedup, packing, periodic, substring_dedup, suffix_dedup, toxicity, url_filter, warc, whitening
from spendwright.llm.check_sql import SQL
from spendwright.sources.session import materialise, new_path

#: (action, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SAME_CONVERSATION = "</s>[INST] ok [/INST]"
TOXIC_FROM = 0.7


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, from dictionaries of the documents that are not held out."""
    docs = _table(spark, folder, "documents").withColumn("held_out", _held_out("doc_id"))
    dictionaries = language_id.fit(docs.where(~F.col("held_out")))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), dictionaries)
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin_bytes", "accepted")


def op2_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.near_classes(_table(spark, folder, "documents"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(_table(spark, folder, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learned from labelled documents that are not held out."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", _held_out("doc_id").alias("held_out"))
    labels = _table(spark, folder, "labels").select("doc_id", "toxic").where(~_held_out("doc_id"))
    sample = toxicity.labelled_sample(docs.where(~F.col("held_out")), labels)
    weights = toxicity.fit(materialise(sample, "labelled-texts"))
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Formatted conversations, read back."""
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    same = [(-1, 0, "user", SAME_CONVERSATION), (-1, 1, "assistant", SAME_CONVERSATION)]
    turns = turns.unionByName(spark.createDataFrame(same, "conv_id long, turn long, role string, text string"))
    made = chat.format_conversations(turns)
    read = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "formatted")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    made = fingerprints.fingerprint_edits(_table(spark, folder, "documents"))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        fingerprints.distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
    )


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontaminate.find(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that repeat an earlier document."""
    cut = substring_dedup.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to archives and read back."""
    path = new_path(spark, "warc")
    warc.write(_table(spark, folder, "pages").select("page_id", "url", "html"), path)
    found = warc.read(spark, path)
    seen = found.select(
        F.col("key").cast("long").alias("page_id"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "stated_digest",
        F.sha1("payload").alias("sha1"),
    )
    seen = materialise(seen, "warc-read")
    stored = seen.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("stated_digest").alias("stored_digest")).distinct()
    whole = seen.join(stored, "refers_to", "left")
    digest = F.when(F.col("record_type") == "response", warc.base32_of_hex(F.col("sha1"))).otherwise(F.col("stored_digest"))
    return whole.select("page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable embedding on the leading principal directions, each with unit variance."""
    rows = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    made = whitening.whiten(rows, model)
    share = F.lit(model.explained).cast("array<double>") if model.explained else F.array().cast("array<double>")
    each = made.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def _made_periodic(key: str, text: str) -> Column:
    """The text, in a tenth of the documents with a periodic end: word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words).cast("long")
    a = F.pmod(g, n)
    period = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    block = F.slice(words, (a + 1).cast("int"), period.cast("int"))
    blocks = F.flatten(F.array_repeat(block, F.ceil((n - a) / period).cast("int")))
    made = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), blocks), F.lit(1), n.cast("int"))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(made, " ")).otherwise(F.col(text))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every document, a tenth of which get a periodic end first."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = periodic.find_runs(docs.withColumn("text", _made_periodic("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    told = found.select("doc_id", "n_words", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"))
    return told.select(
        "doc_id",
        "n_runs",
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat an earlier document."""
    cut = suffix_dedup.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_probminhash,
        op3_url_filter,
        op4_toxicity,
        op5_chat_format,
        op6_fingerprints,
        op7_best_fit_packing,
        op8_decontamination,
        op9_substring_dedup,
        op10_warc,
        op11_embedding_whitening,
        op12_periodic_runs,
        op13_suffix_dedup,
    )
}

__all__ = ["QUERIES", "SQL"]
