"""Substring deduplication with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. Every word is
removed that lies in a window which also starts in a document with a smaller
doc_id. Equal windows share their minimizer, the phrase of ``PHRASE`` words
with the smallest hash in them, so only phrases that recur need a closer look:

1. One pass gives the minimizer phrases of all documents; a count by phrase
   leaves those of two documents or more. What one batch already knows to
   recur is salted, and reaches the count as one witness row.
2. Documents are dealt to shards of bounded size. A shard compiles the
   recurring phrases of its documents into an Aho-Corasick automaton over word
   numbers and streams its documents through it. The windows around the
   occurrences go to a minimum by window hash, one row per window and shard.
3. The shards read their documents again, with the windows that an earlier
   document outside has, and mark every occurrence. Inside a shard a repeated
   window is confirmed word by word.

Texts travel compressed. Windows are told apart across shards by 64-bit hash.

Null and empty texts have no words. The key holds integers. A null doc_id counts as larger than any
other; rows that share a doc_id are not earlier than one another. Long words
and texts are taken whole; an empty table gives no rows. Other columns pass
through, and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwright.llm import words as W

WINDOW, PHRASE = 13, 6
SHARD_BYTES = 4 << 20
RESULT = ("n_words", "n_removed", "kept", "cut_text")
_LAST = np.iinfo(np.int64).max


def _ids(table: pa.Table | pa.RecordBatch, key: str) -> np.ndarray:
    column = table.column(key)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


class Windows:
    """Words, windows and minimizer phrases of a text column."""

    def __init__(self, column: pa.Array):
        self.w = W.words(column, W.BLANK_SEPARATED)
        self.h = self.w.hashes()
        n = len(self.h) - WINDOW + 1
        self.start = np.flatnonzero(self.w.row[:n] == self.w.row[WINDOW - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
        self.phrases = W.grams(self.h, PHRASE)

    def minimizers(self) -> np.ndarray:
        """For each window the place of its smallest phrase (the first of equal ones)."""
        if not len(self.start):
            return self.start
        steps = WINDOW - PHRASE + 1
        best, at = self.phrases[self.start].copy(), self.start.copy()
        for j in range(1, steps):
            other = self.phrases[self.start + j]
            less = other < best
            best[less], at[less] = other[less], self.start[less] + j
        return at

    def hashes(self) -> np.ndarray:
        """The hash of each window."""
        return W.grams(self.h, WINDOW)[self.start]


def _phrases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(phrase, doc, salt, known) of minimizer phrases; ``doc`` is null in a witness row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text):
                x = Windows(part.column(text))
                at = np.unique(x.minimizers())
                doc = _ids(part, key)[x.w.row[at]]
                phrase = x.phrases[at]
                order = np.lexsort((doc, phrase))
                phrase, doc = phrase[order], doc[order]
                new = np.ones(len(phrase), dtype=bool)
                new[1:] = (phrase[1:] != phrase[:-1]) | (doc[1:] != doc[:-1])
                phrase, doc = phrase[new], doc[new]
                begins = np.ones(len(phrase), dtype=bool)
                begins[1:] = phrase[1:] != phrase[:-1]
                group = np.cumsum(begins) - 1
                known = (np.bincount(group) > 1)[group] if len(group) else begins
                witness = begins & known
                columns = [np.concatenate([phrase, phrase[witness]]).view(np.int64)]
                docs_column = pa.array(np.concatenate([doc, doc[witness]]), mask=np.concatenate([np.zeros(len(doc), bool), np.ones(int(witness.sum()), bool)]))
                salt = np.concatenate([np.where(known, doc, -1), np.full(int(witness.sum()), -1, dtype=np.int64)])
                known = np.concatenate([known, np.zeros(int(witness.sum()), dtype=bool)])
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), docs_column, pa.array(salt), pa.array(known)], names=["phrase", "doc", "salt", "known"])

    return docs.select(key, text).mapInArrow(run, "phrase long, doc long, salt long, known boolean")


def _recurring(phrases: DataFrame) -> DataFrame:
    """(doc, phrase) of phrases that start in two documents or more."""
    many = F.count("*").over(Window.partitionBy("phrase", "salt")) > 1
    return phrases.withColumn("many", many | F.col("known")).where("many and doc is not null").select("doc", "phrase")


def _shard_of(key: str, shards: int) -> F.Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(int(_LAST)))), F.lit(shards)).cast("int")


def _compressed(docs: DataFrame, columns: list[str], key: str, text: str, shards: int) -> DataFrame:
    """``docs`` with a shard number and the text as compressed ``body``."""
    others = [c for c in columns if c != text]
    fields = [docs.schema[c] for c in others]
    schema = T.StructType([*fields, T.StructField("body", T.BinaryType()), T.StructField("had_text", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for batch in batches:
            texts = batch.column(text)
            bodies = [press.compress(t.as_buffer()) if t.is_valid else b"" for t in texts]
            arrays = [*[batch.column(c) for c in others], pa.array(bodies, pa.binary()), texts.is_valid()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "body", "had_text"])

    packed = docs.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
    return packed.withColumn("shard", _shard_of(key, shards))


def _texts(table: pa.Table) -> pa.Array:
    open_ = zstandard.ZstdDecompressor()
    bodies = [open_.decompress(b) if b else b"" for b in table.column("body").to_pylist()]
    return pa.array(bodies, pa.large_binary()).cast(pa.large_string())


_BASE = 63


def _symbols(numbers: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first symbol of each word): ``digits`` base-63 symbols for a number above 0, one zero symbol for 0.

    The digits of a number use different symbols by position, so a phrase can
    only be met at the begin of a word, and no node has more than 63 children.
    """
    size = np.where(numbers > 0, digits, 1)
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    known = np.flatnonzero(numbers > 0)
    rest = numbers[known] - 1
    for d in range(digits):
        out[begin[known] + d] = 1 + d * _BASE + rest % _BASE
        rest = rest // _BASE
    return out, begin


def _occurrences(x: Windows, recurring: np.ndarray) -> np.ndarray:
    """Word places at which a recurring phrase begins, found by the shard's automaton."""
    wanted = np.unique(recurring)
    if not len(wanted) or not len(x.phrases):
        return np.zeros(0, dtype=np.int64)
    place = np.minimum(np.searchsorted(wanted, x.phrases), len(wanted) - 1)
    hit = np.flatnonzero(wanted[place] == x.phrases)
    hit = hit[x.w.row[hit] == x.w.row[hit + PHRASE - 1]]
    _, first = np.unique(x.phrases[hit], return_index=True)
    first = hit[first]
    # the words of the phrases are numbered from 1, all others and the ends of documents are 0
    vocabulary = np.unique(x.h[(first[:, None] + np.arange(PHRASE)).ravel()])
    if not len(vocabulary):
        return np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, x.h), len(vocabulary) - 1)
    numbers = np.where(vocabulary[at] == x.h, at + 1, 0)
    digits = 3 if len(vocabulary) <= _BASE**3 else 4
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    keys, begin = _symbols(numbers[(first[:, None] + np.arange(PHRASE)).ravel()], digits)
    text, width = keys.tobytes().decode("latin-1"), digits * PHRASE
    for i in range(0, len(text), width):
        automaton.add_word(text[i : i + width])
    automaton.make_automaton()
    gaps = np.flatnonzero(np.diff(x.w.row)) + 1
    line, begin = _symbols(np.insert(numbers, gaps, 0), digits)
    ends = np.fromiter((end for end, _ in automaton.iter(line.tobytes().decode("latin-1"))), dtype=np.int64)
    words = np.searchsorted(begin, ends - width + 1)
    return words - np.searchsorted(gaps + np.arange(len(gaps)), words)


def _first_rows(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hash, smallest doc) sorted by hash."""
    order = np.lexsort((doc, hashes))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes[new], doc[new]


def _candidates(_key, docs: pa.Table, phrases: pa.Table) -> pa.Table:
    W.give_back()
    x = Windows(_texts(docs))
    doc = _ids(docs, "doc")
    found = _occurrences(x, phrases.column("phrase").to_numpy().view(np.uint64)) if docs.num_rows else np.zeros(0, dtype=np.int64)
    is_found = np.zeros(len(x.h) + 1, dtype=bool)
    is_found[found] = True
    wanted = is_found[x.minimizers()]
    hashes, first = _first_rows(x.hashes()[wanted], doc[x.w.row[x.start[wanted]]])
    shard = np.full(len(hashes), _key[0].as_py() if len(_key) else 0, dtype=np.int32)
    return pa.table({"window": hashes.view(np.int64), "doc": first, "shard": shard})


def _confirmed(x: Windows, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Windows that a document of the shard with a smaller id has, compared word by word."""
    order = np.lexsort((x.start, doc, hashes))
    begins = np.ones(len(order), dtype=bool)
    begins[1:] = hashes[order][1:] != hashes[order][:-1]
    first = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    later = doc[order] > doc[first]
    mine, other = order[later], first[later]
    same = np.ones(len(mine), dtype=bool)
    for j in range(WINDOW):
        a, b = x.start[mine] + j, x.start[other] + j
        same &= (x.h[a] == x.h[b]) & (x.w.end[a] - x.w.start[a] == x.w.end[b] - x.w.start[b])
    out = np.zeros(len(hashes), dtype=bool)
    out[mine[same]] = True
    return out


def _runs(mask: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The masked bytes of each row."""
    at = np.concatenate([[0], np.cumsum(mask)])[offsets]
    body = pa.py_buffer(data[mask].tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), body])


def _cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, end, -1)
    return np.cumsum(delta[:-1]) > 0


def _mark(texts: pa.Array, ids: np.ndarray, flagged: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(words, removed words, kept words joined by blanks, text without the removed words) of each row."""
    x = Windows(texts)
    w, offsets, hashes = x.w, x.w.offsets, x.hashes()
    removed = _confirmed(x, hashes, ids[w.row[x.start]]) | np.isin(hashes, flagged)
    gone = _cover(len(x.h), x.start[removed], x.start[removed] + WINDOW)
    del x, hashes, removed
    rows = len(offsets) - 1
    kept = ~gone
    # kept words and one blank after each that another kept word of its row follows
    places = np.flatnonzero(kept)
    follows = w.row[places[1:]] == w.row[places[:-1]]
    blank = w.end[places[:-1][follows]]
    data = w.data.copy()
    data[blank] = 0x20
    mask = _cover(len(data), w.start[places], w.end[places]) if len(data) else np.zeros(0, dtype=bool)
    mask[blank] = True
    # the text as it was, without removed words and the blanks after them
    until = np.append(w.start[1:], len(w.data))
    until = np.minimum(until, offsets[w.row + 1])
    stays = ~_cover(len(w.data), w.start[gone], until[gone]) if len(w.data) else mask
    return np.bincount(w.row, minlength=rows), np.bincount(w.row[gone], minlength=rows), _runs(mask, data, offsets), _runs(stays, w.data, offsets)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept`` (kept words joined by one blank) and ``cut_text``.

    ``cut_text`` is the text without the removed words, otherwise unchanged (null stays null).
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    columns = [c for c in docs.columns if c not in RESULT]
    recurring = _recurring(_phrases(docs, key, text)).withColumn("shard", _shard_of("doc", shards)).select("shard", "phrase")
    bodies = _compressed(docs.select(F.col(key).cast("long").alias("doc"), text), ["doc", text], "doc", text, shards)
    windows = bodies.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(_candidates, "window long, doc long, shard int")
    earlier = windows.withColumn("first", F.min("doc").over(Window.partitionBy("window"))).where("doc > first").select("shard", "window")

    others = [c for c in columns if c != text]
    fields = [docs.schema[c] for c in others]
    added = [T.StructField(n, t) for n, t in zip(RESULT, (T.LongType(), T.LongType(), T.StringType(), T.StringType()), strict=True)]
    schema = T.StructType([*fields, T.StructField(text, T.StringType()), *added])

    def mark(rows: pa.Table, flagged: pa.Table) -> pa.Table:
        W.give_back()
        texts = _texts(rows)
        count, gone, kept, cut = _mark(texts, _ids(rows, key), flagged.column("window").to_numpy().view(np.uint64))
        had = rows.column("had_text").combine_chunks()
        null = pa.scalar(None, pa.large_string())
        texts, cut = (pa.compute.if_else(had, c, null).cast(pa.string()) for c in (texts, cut))
        arrays = [*[rows.column(c) for c in others], texts, pa.array(count, pa.int64()), pa.array(gone, pa.int64()), kept.cast(pa.string()), cut]
        return pa.table(arrays, names=[*others, text, *RESULT])

    full = _compressed(docs.select(*columns), columns, key, text, shards)
    return full.groupBy("shard").cogroup(earlier.groupBy("shard")).applyInArrow(mark, schema).select(*columns, *RESULT)
