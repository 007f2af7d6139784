"""Best-fit packing of documents into sequences by hierarchical residual packing.

Every partition tokenizes its documents and packs the pieces best-fit
decreasing. Bins with at most ``slack`` free tokens are done. The others are
the items of the next round: they are merged from several tasks into groups of
about ``group_rows`` bins and packed best-fit again, and so on up the tree,
until one group is left or a round neither closes nor merges a bin. A task never holds more than
its partition's pieces or about ``group_rows`` bins of at most ``capacity``
tokens, and only underfull bins are shuffled.

Tokenizing goes through the given tokenizer. As this one drops white space and
never looks across it, or back over the end of a run of letters, the ids of
whole texts are joined from the ids of their words, of which each worker keeps
a bounded table.

Null texts count as empty: one piece with the end id alone. Ties keep the
order of the rows; repeated rows are packed one by one; an empty table gives
no rows; extra columns are ignored. ``doc_id`` holds integers.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendwright.llm import words as W
from spendwright.sources.session import materialise

CAPACITY = 4096
END_ID = 1
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, offset long"
_BIN = f"done boolean, sequence_id long, size long, pieces array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>"
_ARROW_PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))


def _after_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII signs and digits that follow a lower-case ASCII letter: a token ends before them."""
    letter = (data >= 97) & (data <= 122)
    mask = np.zeros(len(data), dtype=bool)
    mask[1:] = letter[:-1] & (data[1:] < 128) & ~letter[1:]
    return mask


_ENCODED = 64_000  # characters encoded at a time


class Tokens:
    """Token ids of texts, with a bounded table of word ids by word hash."""

    _shared: dict[str, Tokens] = {}

    def __init__(self, path: str, most_words: int = 1_000_000):
        # one thread a task: a pool of threads in every worker would hold memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    @classmethod
    def of(cls, path: str) -> Tokens:
        """The worker's tokenizer for this file, kept between tasks."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, some at a time: the tokenizer's own results take many times the bytes of the ids."""
        out, some, size = [], [], 0
        for i, text in enumerate(texts):
            some.append(text)
            size += len(text)
            if size >= _ENCODED or i + 1 == len(texts):
                out += [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                some, size = [], 0
        return out

    def _word_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a line, place and number of each text's). Plain words go in lines: each is one token run that ends with a word end."""
        at, length = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        plain, other = [], []
        for i, text in enumerate(texts):
            (plain if text.isascii() and text.isalpha() else other).append(i)
        lines = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        runs, total = [], 0
        for line, ids in zip(lines, self._encode([" ".join([texts[i] for i in line]) for line in lines]), strict=True):
            found = np.array(ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends_word[found]) + 1
            if len(cuts) != len(line):
                other += line
                continue
            starts = np.concatenate([[0], cuts[:-1]])
            at[line], length[line] = total + starts, cuts - starts
            runs.append(found)
            total += len(found)
        some = self._encode([texts[i] for i in other])
        counts = np.array([len(ids) for ids in some], dtype=np.int64)
        at[other], length[other] = total + np.cumsum(counts) - counts, counts
        runs.append(np.fromiter(chain.from_iterable(some), dtype=np.uint32, count=int(counts.sum())))
        return np.concatenate(runs), at, length

    def _learn(self, w: W.Words, h: np.ndarray) -> None:
        new, where = np.unique(h, return_index=True)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, new), len(self.keys) - 1)
            missing = self.keys[near] != new
            new, where = new[missing], where[missing]
        if not len(new):
            return
        if len(self.keys) + len(new) > self.most and len(self.keys):
            self._clear()
            self._learn(w, h)
            return
        raw = w.data.tobytes()
        found, at, length = self._word_ids([raw[a:b].decode("utf-8") for a, b in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)])
        at += len(self.ids)
        self.ids = np.concatenate([self.ids, found])
        place = np.searchsorted(self.keys, new)
        self.keys = np.insert(self.keys, place, new)
        self.at, self.length = np.insert(self.at, place, at), np.insert(self.length, place, length)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a line, row offsets); each row ends with ``end_id``."""
        data, _ = W.buffers(column)
        marked = b"<|" in data.tobytes()  # may hold the string of a special token: keep such words as they are
        w = W.words(column, W.BLANK_SEPARATED, lower=not marked, cut=None if marked else _after_letters)
        h = w.hashes()
        self._learn(w, h)
        place = np.searchsorted(self.keys, h)
        length = self.length[place] if len(h) else np.zeros(0, dtype=np.int64)
        before = np.cumsum(length) - length
        total, rows = int(length.sum()), len(column)
        ids = np.full(total + rows, end_id, dtype=np.uint32)
        if total:
            source = np.repeat(self.at[place] - before, length) + np.arange(total)
            ids[np.arange(total) + np.repeat(w.row, length)] = self.ids[source]
        ends = np.cumsum(np.bincount(w.row, weights=length, minlength=rows).astype(np.int64) + 1)
        return ids, np.concatenate([[0], ends])


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset in it) of each item.

    The free places with a bin are the bits of one integer, so the tightest
    fitting bin is found without a search over bins.
    """
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
        else:
            free, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - free
        if free > size:
            by_free[free - size].append(b)
            free_bits |= 1 << (free - size)
    return bins, offsets


def _bins(items: list[tuple[int, list[dict]]], capacity: int, slack: int, first_id: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Pack (size, pieces) items and give the bins as record batches."""
    sizes = np.array([size for size, _ in items], dtype=np.int64)
    bins, offsets = best_fit(sizes, capacity)
    count = int(bins.max()) + 1 if len(bins) else 0
    contents: list[list[dict]] = [[] for _ in range(count)]
    total = np.bincount(bins, weights=sizes, minlength=count).astype(np.int64)
    for (_, pieces), b, offset in zip(items, bins.tolist(), offsets.tolist(), strict=True):
        contents[b] += [{**p, "offset": p["offset"] + offset} for p in pieces]
    done = (capacity - total <= slack) | last
    for at in range(0, count, 2000):
        part = slice(at, min(at + 2000, count))
        ids = np.arange(part.start, part.stop, dtype=np.int64) + first_id
        yield pa.RecordBatch.from_arrays([pa.array(done[part]), pa.array(ids), pa.array(total[part]), pa.array(contents[part], _ARROW_PIECES)], names=["done", "sequence_id", "size", "pieces"])


def _id(level: int, part: int) -> int:
    return (level << 56) + (part << 28)


def _merger(level: int, last: bool, capacity: int, slack: int):
    def merge(group: pa.Table) -> pa.Table:
        items = list(zip(group["size"].to_pylist(), group["pieces"].to_pylist(), strict=True))
        return pa.Table.from_batches(_bins(items, capacity, slack, _id(level, group["g"][0].as_py()), last))

    return merge


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = 8, group_rows: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` has doc_id and text; ``tokenizer`` is the path of a tokenizers
    file that every executor has. Only documents longer than ``capacity`` are
    cut, into pieces of ``capacity`` tokens; the last piece may be shorter.
    """

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, items = Tokens.of(tokenizer), []
        for batch in batches:
            for part in W.slices(batch, "text", 1_000_000):
                ids, at = tokens.encode(part.column("text"), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                for doc, begin, end in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for n, start in enumerate(range(begin, end, capacity)):
                        stop = min(start + capacity, end)
                        piece = {"doc_id": doc, "piece": n, "start": start - begin, "length": stop - start, "ids_crc32": zlib.crc32(raw[start * 4 : stop * 4]), "offset": 0}
                        items.append((stop - start, [piece]))
        yield from _bins(items, capacity, slack, _id(0, TaskContext.get().partitionId()), False)

    made = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first_round, _BIN), "bins-0")
    finished = [made.where("done")]
    left = made.where("not done")
    rows, before, level = left.count(), None, 1
    while rows:
        groups = max(1, -(-rows // group_rows))
        # a round that neither closed nor merged a bin cannot do so by another merge of the same size: then all bins stand
        last = groups == 1 or rows == before
        merged = left.select((F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).cast("int").alias("g"), "size", "pieces")

        made = materialise(merged.groupBy("g").applyInArrow(_merger(level, last, capacity, slack), _BIN), f"bins-{level}")
        finished.append(made.where("done"))
        left = made.where("not done")
        before, rows, level = rows, left.count(), level + 1
    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionByName(part)
    p = whole.select("sequence_id", F.explode("pieces").alias("p"))
    return p.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
