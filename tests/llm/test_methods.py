"""Operators against brute force, round trips and their own other paths."""

import gzip
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendwright.llm import decontaminate, fingerprints, language_id, near_dedup, packing, substring_dedup, toxicity, url_filter, warc
from spendwright.llm.queries import URL_RULES


def prose(seed, n):
    rng = random.Random(seed)
    return [rng.choice("the of and to in that was re").strip() if rng.random() < 0.05 else f"w{rng.randrange(5000)}" for _ in range(n)]


def shingle_counts(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def jp(a, b):
    """Probability Jaccard by its definition."""
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[k] / a[d], b[k] / b[d]) for k in keys) for d in keys if a[d] and b[d])


def test_near_classes_equal_brute_force(spark):
    texts = [None, "", "one two", "One, two!", "%%", "%%", "&&"]
    for base in range(6):
        words = prose(base, 120)
        texts += [" ".join(words)] * 3
        for copy in range(12):
            rng, edited = random.Random(100 * base + copy), list(words)
            for _ in range(copy):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
        texts.append(" ".join(words * 3) + " tail")
    texts += [" ".join(prose(50 + i, 80)) for i in range(10)]
    random.Random(3).shuffle(texts)
    counts = [shingle_counts(t or "") for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            alike = jp(counts[i], counts[j]) >= 0.8 if counts[i] and counts[j] else not counts[i] and not counts[j] and (texts[i] or "") == (texts[j] or "")
            if alike and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id")], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))} | {None: None}


def test_probminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 5, 300).astype(float), rng.integers(0, 5, 300).astype(float)
    row = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sig = near_dedup.probminhash(np.concatenate([h[a > 0], h[b > 0]]), row, np.concatenate([a[a > 0], b[b > 0]]), 2, 2048)
    order = np.argsort(h)
    sides = [(h[order][x[order] > 0], x[order][x[order] > 0]) for x in (a, b)]
    exact = near_dedup.similarity(*sides)
    assert exact == pytest.approx(jp(Counter(dict(zip(h.tolist(), a))), Counter(dict(zip(h.tolist(), b)))))
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.05)


def test_tokens_equal_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["It's Réan, éa!! (a)b's 12ab3c", "", "<|endoftext|> Ab<|ENDOFTEXT|>c", "a b\x1cc　d ½ ＡＢ", "don't we'll x'd 'S", "ab̸≠ K ſ İ", "tab\tnew\nline  two", "日本語 text，mixed"]
    plain = Tokenizer.from_file(path)
    tokens = packing.Tokens(path, most_words=20)
    for column in (texts, texts[:2], texts[3:]):
        ids, at = tokens.encode(pa.array(column, pa.string()), 1)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain.encode(t, add_special_tokens=False).ids + [1] for t in column]


def test_packing_keeps_every_token(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", *[" ".join(prose(i, 5 + 37 * i)) for i in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    rows = packing.pack(docs, path, group_rows=5).collect()
    plain = Tokenizer.from_file(path)
    for doc, text in enumerate(texts):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [(p["start"], p["length"]) for p in pieces] == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:i]) for i, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 4096) + 5  # groups of five bins waste a little


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([3, 6, 5, 4, 2]), 10)
    assert bins.tolist() == [1, 0, 1, 0, 1] and offsets.tolist() == [5, 0, 0, 6, 8]


def test_fingerprints(spark):
    texts = [None, "", "a", *[" ".join(prose(i, 40 * i)) for i in range(1, 12)], " ".join(prose(5, 200)), " ".join(prose(5, 180) + prose(77, 20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text, follower = text or "", texts[i - 1] or ""
        third = len(text) // 3
        assert rows[i]["edited"] == text[: len(text) - third] + follower[:third]

    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    for i, r in rows.items():
        a, b = sets(texts[i] or ""), sets(r["edited"])
        want = len(a & b) / len(a | b) if a | b else 1.0
        assert r["near_edited"] == pytest.approx(want, abs=0.15 if len(a | b) > 128 else 1e-9)
    one, two = fingerprints.sketch(F.lit(" ".join(prose(1, 300)))), fingerprints.sketch(F.lit(" ".join(prose(1, 300)[:200])))
    got = spark.range(1).select(fingerprints.containment(two, one).alias("c"), fingerprints.distinct_shingles(one).alias("n"), fingerprints.merge(one, two).alias("m"), one.alias("o")).first()
    assert got["c"] > 0.8 and abs(got["n"] - 296) < 90 and got["m"] == got["o"]


def test_next_document_does_not_depend_on_the_ranges(spark):
    rows = [(random.Random(i).randrange(10**6), f"t{i} " * 50) for i in range(300)] + [(7, "same"), (7, "same"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.length("text"))
    told = [sorted((r["doc_id"] or -1, r["text"], r["next"]["text"]) for r in fingerprints.with_next(docs, "v", size).collect()) for size in (1 << 30, 2000)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert told[0] == told[1] == sorted((a[0] or -1, a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))


def test_shards_and_blocks_change_nothing(spark):
    shared = " ".join(prose(999, 60))
    texts = [" ".join(prose(i, 50)) + " " + (shared if i % 3 else "") + " " + " ".join(prose(1000 + i, 30)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    cut = [sorted(substring_dedup.remove_repeats(docs, shard_bytes=size).collect()) for size in (1 << 24, 3000)]
    assert cut[0] == cut[1] and sum(r["n_removed"] > 0 for r in cut[0]) == 25
    assert all(r["cut_text"].split() == r["kept"].split() for r in cut[0])
    bench = spark.createDataFrame([(i, " ".join(prose(i, 50)[:20])) for i in range(10)], "item_id int, text string")
    found = [sorted(decontaminate.find(docs, bench, block_bytes=size).collect()) for size in (1 << 20, 200)]
    assert found[0] == found[1] and [r["doc_id"] for r in found[0] if r["items"]] == list(range(10))


def test_suffix_buckets_equal_brute_force():
    """Patterns that share suffixes, prefixes or both, in texts that come close to them."""
    rng = random.Random(5)
    items = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    patterns = decontaminate.windows(items, [str(i) for i in range(len(items))], 10)
    tables = [decontaminate.Table.of(vars(decontaminate.Table(n, p))) for n, p in patterns.items()]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 700))) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = decontaminate._hits(batch, tables, ["text"], "text").to_pylist()
    for row, text in zip(found, texts, strict=True):
        words, hit, named = text.split(), set(), set()
        for i, item in enumerate(items):
            parts = item.split()
            n = min(10, len(parts))
            for w in {tuple(parts[j : j + n]) for j in range(len(parts) - n + 1)}:
                for at in range(len(words) - n + 1):
                    if tuple(words[at : at + n]) == w:
                        hit |= set(range(at, at + n))
                        named.add(str(i))
        assert {k for s in row["spans"] for k in range(s["start"], s["end"])} == hit
        assert row["items"] == sorted(named)


def test_repeated_rules_and_empty_hosts(spark):
    rules = [("block", "net", "/"), ("allow", "net", "/"), ("allow", "org", "/"), ("block", "org", "/"), ("block", "", "/")]
    pages = spark.createDataFrame([(0, "http://net/x"), (1, "http:///x"), (2, "http://a.org/"), (3, "http://b.com/")], "page_id int, url string")
    for most in (1 << 30, 1):
        told = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, most_bytes=most).collect()}
        assert told == {0: ("net/", "block"), 1: (None, "allow"), 2: ("org/", "block"), 3: (None, "allow")}


def test_packing_merges_until_no_bin_changes(spark, tmp_path):
    """Many small groups: the tree goes on while bins merge, and ends close to the least number of bins."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', cast(3 + id * 7 % 40 AS int)) AS text").repartition(60)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, capacity=64, slack=0, group_rows=40).toPandas()
    assert len(rows) == 3000
    filled = rows.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 64
    assert len(filled) <= 1.12 * -(-int(rows["length"].sum()) // 64)


def test_url_rules_mapped_and_joined_agree(spark):
    urls = ["http://a.example.net/en/x", "http://example.net/de/", "http://q.org/fr/", "http://q.org/", None, "http://example.com/de/a?b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    mapped = sorted(url_filter.judge(pages, URL_RULES).collect(), key=lambda r: r["page_id"])
    joined = sorted(url_filter.judge(pages, URL_RULES, most_bytes=1).collect(), key=lambda r: r["page_id"])
    assert mapped == joined and [r["verdict"] for r in mapped] == ["allow", "block", "allow", "allow", "allow", "block"]


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_key", lambda host, path: 7)
    url_filter.Digests.write([("block", "a.b", "/"), ("allow", "c.d", "/x")], str(tmp_path), "r")
    digests = url_filter.Digests(str(tmp_path), "r")
    assert digests.probe(["z.c.d", "a.b", "q"], ["/xy", "/", "/"]) == [("c.d/x", "allow"), ("a.b/", "block"), None]


def test_warc_round_trip_and_broken_archives():
    payload = bytes(range(256)) * 300
    parts = list(warc.records("1", "http://a/", payload, warc.base32_sha1(payload), None, 10_000))
    assert len(parts) > 5
    blocks = [block for _, block in warc.parse(b"".join(p + b"\r\n\r\n" for p in parts))]
    assert warc.dechunk(b"".join(blocks).partition(b"\r\n\r\n")[2]) == payload
    for bad in (b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab", b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nab")


def test_archives_of_other_writers(spark, tmp_path):
    def record(kind, name, block, more=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{more}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    body = bytes(range(256)) * 20
    both = http + body
    records = [
        record("warcinfo", "i", b"software: x\r\n"),
        record("request", "q", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", "r", http + b"plain\xff\x00"),
        record("response", "d", b"20240101\nexample.net. 1 IN A 1.2.3.4\n"),
        record("resource", "f", b"file"),
        record("revisit", "v", http, "WARC-Refers-To: <urn:uuid:r>\r\n"),
        record("response", "s", both[:3000], "WARC-Segment-Number: 1\r\n"),
        record("continuation", "s2", both[3000:], f"WARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <urn:uuid:s>\r\nWARC-Segment-Total-Length: {len(both)}\r\n"),
    ]
    folder = tmp_path / "archives"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:6]))
    (folder / "b.warc").write_bytes(b"".join(records[6:]))
    rows = {r["key"]: (r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in warc.read(spark, str(folder)).collect()}
    assert rows == {
        "<urn:uuid:i>": ("warcinfo", None, None),
        "<urn:uuid:q>": ("request", None, None),
        "<urn:uuid:r>": ("response", None, b"plain\xff\x00"),
        "<urn:uuid:d>": ("response", None, b"20240101\nexample.net. 1 IN A 1.2.3.4\n"),
        "<urn:uuid:f>": ("resource", None, b"file"),
        "<urn:uuid:v>": ("revisit", "<urn:uuid:r>", None),
        "<urn:uuid:s>": ("response", None, body),
    }
    with pytest.raises(ValueError):
        warc.inflate(gzip.compress(records[0])[:-9])


def test_lost_segment_is_an_error(spark):
    rows = [("response", "<urn:page:1>", None, None, None, 1, None, bytearray(b"ab")), ("continuation", "<urn:page:1:3>", None, None, "<urn:page:1>", 3, 4, bytearray(b"cd"))]
    parts = spark.createDataFrame(rows, warc._PARTS)
    with pytest.raises(Exception, match="segments are not whole"):
        warc.reassemble(parts).collect()


def test_classifiers_learn(spark):
    a, b = "der die das und ist nicht ein eine zu auf".split(), "the of and is not a to in that it".split()
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(a if i % 2 else b) for _ in range(60)) + (" vile scum" if i % 5 == 0 else ""), "de" if i % 2 else "en", int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, toxic int")
    found = language_id.identify(docs, language_id.fit(docs, texts_per_language=50))
    assert found.where("lang <> lang_pred").count() == 0
    assert language_id.identify(spark.createDataFrame([(None,), ("12 %",)], "text string"), {}).where("lang_pred <> 'und' or accepted").count() == 0
    scored = toxicity.score(docs, toxicity.fit(docs))
    assert scored.where("(score >= 0.7) <> (toxic = 1)").count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        assert docs.columns == columns and docs.count() > 0.7 * whole
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_tokens_are_encoded_some_at_a_time():
    from spendwright.llm import packing

    sizes = []

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            sizes.append(sum(map(len, texts)))
            return [type("Encoding", (), {"ids": [len(t)]}) for t in texts]

    tokens = object.__new__(packing.Tokens)
    tokens.tokenizer = Counted()
    texts = ["x" * (i % 700) for i in range(2000)]
    assert tokens._encode(texts) == [[len(t)] for t in texts] and tokens._encode([]) == []
    assert len(sizes) > 1 and max(sizes) < packing._ENCODED + 700


def test_workers_hold_little_while_tokens_are_made(monkeypatch):
    # no pool of threads per worker, and what the last slice took is returned as well
    from spendwright.llm import words

    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    path = public_tokenizers.path("word_bpe_49k.json")
    packing.Tokens(path)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    returned = []
    monkeypatch.setattr(words, "give_back", lambda: returned.append(len(seen)))
    seen = []
    for part in words.slices(pa.record_batch({"text": ["one two", "three", "four"]}), "text", 9):
        seen.append(part)
    assert len(seen) == 2 and returned == [0, 2]
