"""URL filtering by a sorted array of digests.

The rules' 64-bit xxhash keys lie sorted in a file that every executor maps
into memory. The candidate keys of a batch of URLs (each host suffix with each
path prefix of a length that some rule has) are probed by one vectorised
binary search, and a hit counts only if the stored rule string is equal.

A rule is ``host/path``: it fits its host and all subdomains where the URL's
path starts with the rule's path. The longest fitting rule wins; of equally
long ones the one with the longer host; where one rule is listed with both
actions, block. A rule with an empty host fits nothing. No fitting rule:
``default`` (allow).

Null URLs and URLs without ``://`` have empty host and path and fit no rule.
Repeated rows are judged one by one; an empty table gives no rows; an empty
rule list gives the default everywhere. Other columns pass through, and one
named like a result is replaced.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = ("host", "path", "rule", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest list that is sent to the executors; beyond it :func:`judge` joins on the digests.
MOST_BYTES = 1 << 30


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and path (then up to ``? #``)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _key(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\n{path}")


class Digests:
    """The mapped list: sorted keys, actions, and the rule strings by offset."""

    def __init__(self, folder: str, name: str):
        self.keys = np.load(os.path.join(folder, f"{name}.keys.npy"), mmap_mode="r")
        self.actions = np.load(os.path.join(folder, f"{name}.actions.npy"), mmap_mode="r")
        self.offsets = np.load(os.path.join(folder, f"{name}.offsets.npy"), mmap_mode="r")
        self.text = np.load(os.path.join(folder, f"{name}.text.npy"), mmap_mode="r")
        self.lengths = np.load(os.path.join(folder, f"{name}.lengths.npy")).tolist()

    @staticmethod
    def write(rules: Iterable[tuple[str, str, str]], folder: str, name: str) -> list[str]:
        """Write (action, host, path) rules as mapped files; their paths. Of a rule with both actions block counts."""
        listed: dict[tuple[str, str], str] = {}
        for action, host, path in rules:
            if host and listed.get((host, path)) != "block":
                listed[host, path] = action
        rows = sorted((_key(host, path), host, path, action) for (host, path), action in listed.items())
        texts = [f"{host}\n{path}".encode() for _, host, path, _ in rows]
        arrays = {
            "keys": np.array([r[0] for r in rows], dtype=np.uint64),
            "actions": np.array([r[3] == "allow" for r in rows], dtype=bool),
            "offsets": np.cumsum([0, *map(len, texts)], dtype=np.int64),
            "text": np.frombuffer(b"".join(texts) or b"\n", dtype=np.uint8),
            "lengths": np.unique(np.array([len(r[2]) for r in rows], dtype=np.int64)),
        }
        paths = []
        for label, array in arrays.items():
            paths.append(os.path.join(folder, f"{name}.{label}.npy"))
            np.save(paths[-1], array)
        return paths

    def probe(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """(rule, action) of the longest fitting rule of each URL."""
        owner: list[int] = []
        texts: list[tuple[str, str]] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            suffix = host
            while suffix:
                for n in self.lengths:
                    if n <= len(path):
                        owner.append(i)
                        texts.append((suffix, path[:n]))
                _, dot, suffix = suffix.partition(".")
                if not dot:
                    break
        out: list[tuple[str, str] | None] = [None] * len(hosts)
        if not texts or not len(self.keys):
            return out
        keys = np.array([_key(h, p) for h, p in texts], dtype=np.uint64)
        at = np.searchsorted(self.keys, keys)
        best: list[tuple[int, int]] = [(-1, -1)] * len(hosts)
        for j in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            host, path = texts[j]
            place = self._confirm(int(at[j]), keys[j], f"{host}\n{path}".encode())
            size = (len(host) + len(path), len(host))
            if place is not None and size > best[owner[j]]:
                best[owner[j]] = size
                out[owner[j]] = (host + path, "allow" if self.actions[place] else "block")
        return out

    def _confirm(self, at: int, key: np.uint64, text: bytes) -> int | None:
        """The place of ``text`` among the entries with this key, if it is there."""
        while at < len(self.keys) and self.keys[at] == key:
            if self.text[self.offsets[at] : self.offsets[at + 1]].tobytes() == text:
                return at
            at += 1
        return None


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The list travels to the executors as files if it is at most ``most_bytes``
    long; a longer one is joined on the digests instead (:func:`judge_joined`).
    """
    size = sum(len(h.encode()) + len(p.encode()) + 18 for _, h, p in rules)
    if size > most_bytes:
        spark = pages.sparkSession
        return judge_joined(pages, spark.createDataFrame(rules, "action string, host string, path string"), url, default)
    kept = [c for c in pages.columns if c not in RESULT]
    host, path = host_and_path(F.col(url))
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    name = f"rules-{uuid.uuid4().hex}"
    for file in Digests.write(rules, tempfile.mkdtemp(prefix="rules-"), name):
        pages.sparkSession.sparkContext.addFile(file)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(SparkFiles.getRootDirectory(), name)
        for batch in batches:
            found = digests.probe(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return parsed.mapInArrow(probe, schema)


def judge_joined(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The same for a list of any size: distinct URLs' candidate keys are joined with the rules."""
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in RESULT]
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    lengths = [r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = parsed.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"), prefixes.alias("prefixes"))
    keys = keys.select("host", "path", "rule_host", F.explode("prefixes").alias("rule_path"))
    listed = rules.select(F.col("action"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).where("host <> ''")
    size = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("rule"), "action")
    best = keys.join(listed, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(size).alias("best"))
    verdict = F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict")
    return parsed.join(best, ["host", "path"], "left").select(*kept, "host", "path", F.col("best.rule").alias("rule"), verdict)
