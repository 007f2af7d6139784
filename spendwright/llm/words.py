"""Words, word hashes and shingles of whole Arrow text columns, in numpy.

Every function works on the byte buffer of a column, so no Python object per
word or document is made. Word classes are defined on ASCII bytes; all bytes
of other characters belong to words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG = 512  # bytes; rarer longer words are hashed one by one


def _table(separators: set[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
BLANK_SEPARATED = _table({0x20, *range(0x09, 0x0E)})
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, for text whose A-Z are lower-cased
ALPHANUMERIC = _table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1 of them, from 0) of a text column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system; workers are kept between stages, each with what its largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of about ``most`` text bytes (one row at least)."""
    give_back()
    texts = batch.column(column)
    if not len(texts):
        return
    _, offsets = buffers(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield batch.slice(start, end - start)
        start = end
    give_back()


@dataclass
class Words:
    """The words of a text column: byte ranges in ``data`` and the row of each."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def first(self) -> np.ndarray:
        """For each row the number of words before it, with the total at the end."""
        return np.searchsorted(self.start, self.offsets, side="left")

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        length = self.end - self.start
        h = length.astype(np.uint64) * _STEP
        if not len(h):
            return h
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
        todo = np.flatnonzero(length <= _LONG) if int(length.max()) > _LONG else None
        at = 0
        where = slice(None) if todo is None else todo
        while True:
            left = length[where] - at
            part = eight[self.start[where] + at]
            short = left < 8
            keep = np.where(short, (np.uint64(1) << (np.maximum(left, 0) * 8 % 64).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
            h[where] = mix((h[where] ^ (part & keep)) + _STEP)
            at += 8
            where = np.flatnonzero(length > at) if todo is None else todo[length[todo] > at]
            if not len(where):
                break
        for i in np.flatnonzero(length > _LONG) if todo is not None else ():
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return h


def words(column: pa.Array, table: np.ndarray, lower: bool = False, cut: Callable[[np.ndarray], np.ndarray] | None = None) -> Words:
    """The words of every row: maximal runs of bytes that ``table`` marks.

    ``cut`` gives from the bytes a mask of those that begin a new word even inside a run.
    """
    data, offsets = buffers(column)
    if lower:
        data = lower_ascii(data)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = table[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    if cut is not None:
        before[:-1] &= ~cut(data)
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside[1:] & before[1:]  # a word that begins here ends the one before
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, start, end, row)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` consecutive word hashes, rows not minded (len - n + 1 of them)."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(count, n, dtype=np.uint64) * _A
    for j in range(n):
        out = out * _STEP + h[j : j + count]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``n`` words inside a row.

    A row of fewer words, but not none, has one shingle: all of its words.
    """
    h, first = w.hashes(), w.first()
    g = grams(h, n)
    inside = w.row[: len(g)] == w.row[n - 1 :] if len(g) else np.zeros(0, dtype=bool)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    extra = np.array([grams(h[first[r] : first[r] + count[r]], int(count[r]))[0] for r in short], dtype=np.uint64)
    hashes = np.concatenate([g[inside], extra])
    rows = np.concatenate([w.row[: len(g)][inside], short])
    if len(short):
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def grams_of_rows(h: np.ndarray) -> np.ndarray:
    """One hash for the values along the last axis."""
    out = np.full(h.shape[:-1], h.shape[-1], dtype=np.uint64) * _A
    for j in range(h.shape[-1]):
        out = out * _STEP + h[..., j]
        out ^= out >> np.uint64(29)
    return mix(out)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, end, -1)
    return np.cumsum(delta[:-1]) > 0


def masked(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The marked bytes of each row, as large strings or large binaries."""
    at = np.concatenate([[0], np.cumsum(mask)])[offsets]
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data[mask].tobytes())])


def joined(w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one blank."""
    places = np.flatnonzero(kept)
    follows = w.row[places[1:]] == w.row[places[:-1]]
    blank = w.end[places[:-1][follows]]  # a separator, as another word of the row follows
    data = w.data.copy()
    data[blank] = 0x20
    mask = covered(len(data), w.start[places], w.end[places])
    mask[blank] = True
    return masked(data, w.offsets, mask, pa.large_string())
