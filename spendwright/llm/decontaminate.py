"""Benchmark decontamination by Wu-Manber multi-pattern search on words.

Patterns are the windows of ``n`` consecutive words of the benchmark items
(an item of fewer words is one window). Patterns of one length share a table:
the hash of a block of two words gives a shift, the distance by which the
search may jump since no pattern has that block nearer to its end. Where the
shift is zero, the bucket of the window's suffix (the hash of its last block)
holds the patterns to test; in it they are ordered by the hash of their first
block, so only those with the window's prefix are left, and a direct
comparison of the words' bytes confirms the occurrence.

All documents of a batch are searched side by side: every lane of a few
hundred window positions jumps by its own shift, in numpy. Documents are read
in one pass and never shuffled. Tables are built once, on the driver, and
broadcast as arrays in blocks of a bounded size; a task searches its batch
with one block after the other. A worker holds all of them, so the benchmark
has to fit into a worker's memory about ten times.

Null and empty texts have no words, no hits and are clean. Repeated documents
are searched one by one; repeated items count as items of their own; items
with a null id are listed as one null; items without words match
nothing; empty tables give no rows or clean rows. Other
columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwright.llm import words as W

RESULT = ("n_words", "spans", "items")
BLOCK_BYTES = 32 << 20  # benchmark text in one broadcast
LANE = 256
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class Table:
    """Shift table, buckets and words of all patterns of one length."""

    def __init__(self, length: int, patterns: dict[bytes, set[int]]):
        """``patterns``: words joined by a blank, with the items that have them."""
        self.length = length
        self.patterns = sorted(patterns)
        self.items = [sorted(patterns[p], key=_by_name) for p in self.patterns]
        w = W.words(pa.array([p.decode("utf-8", "surrogateescape") for p in self.patterns], pa.large_string()), W.ALPHANUMERIC)
        h = w.hashes().reshape(len(self.patterns), length)
        self.block = min(2, length)
        steps = length - self.block + 1  # block positions in a pattern
        self.suffixes, number = np.unique(self._blocks(h, steps - 1), return_inverse=True)
        inside = self._inside(number, self._blocks(h, 0))
        self.bucket = np.argsort(inside, kind="stable")
        self.inside = inside[self.bucket]
        blocks = np.concatenate([self._blocks(h, j) for j in range(steps)])
        shift = np.repeat(np.arange(steps - 1, -1, -1), len(self.patterns))
        order = np.lexsort((shift, blocks))
        blocks, shift = blocks[order], shift[order]
        first = np.ones(len(blocks), dtype=bool)
        first[1:] = blocks[1:] != blocks[:-1]
        self.blocks, self.shift, self.most = blocks[first], shift[first], steps

    @classmethod
    def of(cls, state: dict) -> Table:
        """A table from the attributes of another one, as they are broadcast."""
        table = cls.__new__(cls)
        table.__dict__.update(state)
        return table

    @staticmethod
    def _inside(bucket: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Order of a pattern: its bucket's number, then half of its prefix hash."""
        return (bucket.astype(np.uint64) << np.uint64(32)) | (prefix >> np.uint64(32))

    def _blocks(self, h: np.ndarray, at: int) -> np.ndarray:
        return self.hash_block([h[:, at + j] for j in range(self.block)])

    def hash_block(self, parts: list[np.ndarray]) -> np.ndarray:
        out = parts[0].copy()
        for p in parts[1:]:
            out = W.mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
        return out

    def shifts(self, blocks: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.blocks, blocks), len(self.blocks) - 1)
        return np.where(self.blocks[at] == blocks, self.shift[at], self.most)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Window starts at which the shift is zero; ``first`` are the rows' word offsets."""
        count = np.maximum(np.diff(first) - self.length + 1, 0)  # windows of each row
        lanes = -(-count // LANE)
        row = np.repeat(np.arange(len(count)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[row] + nth * LANE
        end = np.minimum(at + LANE, first[row] + count[row])
        found = []
        while len(at):
            last = at + self.length - self.block
            jump = self.shifts(self.hash_block([h[last + j] for j in range(self.block)]))
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < end
            at, end = at[live], end[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def search(self, w: W.Words, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence."""
        starts = self.candidates(h, w.first())
        if not len(starts):
            return
        suffix, prefix = (self.hash_block([h[starts + at + j] for j in range(self.block)]) for at in (self.length - self.block, 0))
        wanted = self._inside(np.searchsorted(self.suffixes, suffix), prefix)
        left = np.searchsorted(self.inside, wanted, side="left")
        right = np.searchsorted(self.inside, wanted, side="right")
        for i in np.flatnonzero(right > left):
            at = int(starts[i])
            text = b" ".join(w.data[w.start[at + j] : w.end[at + j]].tobytes() for j in range(self.length))
            for k in self.bucket[left[i] : right[i]]:
                if self.patterns[k] == text:
                    yield at, int(k)


def windows(texts: list[str | None], ids: list, n: int) -> dict[int, dict[bytes, set]]:
    """Patterns by length: the word windows of every item, with the items that have them."""
    out: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
    column = pa.array(texts, pa.large_string())
    w = W.words(column, W.ALPHANUMERIC, lower=True)
    first = w.first()
    for r, item in enumerate(ids):
        parts = [w.data[w.start[i] : w.end[i]].tobytes() for i in range(first[r], first[r + 1])]
        length = min(n, len(parts))
        for at in range(len(parts) - length + 1 if length else 0):
            out[length][b" ".join(parts[at : at + length])].add(item)
    return {k: dict(v) for k, v in out.items()}


def _by_name(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (hit word ranges, end excluded) and ``items`` (as sorted strings, a null last)."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in RESULT]
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))])
    listed = benchmark.select(F.col(item).cast("string").alias("item"), F.col("text").alias("text"))
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    shared = []
    for b in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        patterns = windows([r["text"] for r in part], [r["item"] for r in part], n)
        shared.append(spark.sparkContext.broadcast([vars(Table(length, patterns[length])) for length in sorted(patterns)]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Table.of(state) for block in shared for state in block.value]
        for batch in batches:
            for part in W.slices(batch, text):
                yield _hits(part, tables, kept, text)

    return docs.select(*kept).mapInArrow(search, schema)


def _hits(part: pa.RecordBatch, tables: list[Table], kept: list[str], text: str) -> pa.RecordBatch:
    w = W.words(part.column(text), W.ALPHANUMERIC, lower=True)
    h, first = w.hashes(), w.first()
    spans: list[list[tuple[int, int]]] = [[] for _ in range(part.num_rows)]
    items: list[set[str]] = [set() for _ in range(part.num_rows)]
    for table in tables:
        for at, k in table.search(w, h):
            r = int(w.row[at])
            begin = at - int(first[r])
            if spans[r] and spans[r][-1][0] <= begin <= spans[r][-1][1]:
                spans[r][-1] = (spans[r][-1][0], max(spans[r][-1][1], begin + table.length))
            else:
                spans[r].append((begin, begin + table.length))
            items[r].update(table.items[k])
    found = [[{"start": s, "end": e} for s, e in _union(row)] for row in spans]
    columns = [part.column(c) for c in kept]
    columns += [pa.array(np.diff(first), pa.int64()), pa.array(found, pa.list_(_ARROW_SPAN)), pa.array([sorted(i, key=_by_name) for i in items], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[*kept, *RESULT])
