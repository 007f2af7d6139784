"""Periodic runs of words by Kruskal's order over common prefixes.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) and a length of at least ``max(LEAST_LENGTH, LEAST_EXPONENT * q)``
that no neighbouring word extends.

For each document the suffixes that share ``SEED`` words with another are
sorted (prefix doubling in numpy), with the common prefix of neighbours. Classes
of suffixes are then united by decreasing common prefix L, as in Kruskal's
algorithm: a union-find over ordered sets of positions, the smaller set put into
the larger. Two positions that become adjacent at distance q <= L / 3 begin
equal stretches of L words, so a run of period q and length q + L begins at the
first of them, unless the word before it continues the period. Of what begins
and ends alike the smallest period is the run.

The shortest run has a common prefix of ``SEED`` words, so a word that lies in
no repeated stretch of that size is left out before the sort; ordinary
documents keep almost nothing. Word hashes only select; the words that are left
are compared byte by byte.

There is no shuffle: each document is handled where it is read, in batches of
bounded size, with at most n log n set insertions for n words. Null and empty
texts have no words and no runs. Repeated rows and null keys are rows like
others. A text is taken whole, however long. Empty tables give no rows. Other
columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spendwright.llm import words as W

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: a run of period q has a common prefix of length - q words: 5 where q = 1, 3 q and 6 or more elsewhere
SEED = LEAST_LENGTH - 1
BATCH_BYTES = 1_000_000
RESULT = ("n_words", "runs", "collapsed")
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _tokens(w: W.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, word place) of the words in repeated stretches; a place of -1 is an end, equal to nothing else."""
    g = W.grams(h, SEED)
    inside = np.flatnonzero(w.row[: len(g)] == w.row[SEED - 1 :]) if len(g) else np.zeros(0, dtype=np.int64)
    key = W.mix(g[inside] + w.row[inside].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(inside), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    marked = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(marked, inside[again], 1)
    np.add.at(marked, inside[again] + SEED, -1)
    place = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
    if not len(place):
        return np.zeros(0, dtype=np.int64), place
    ids = _same_words(w, h, place)
    ids = _dense(ids + w.row[place] * (ids.max() + 1))
    breaks = np.flatnonzero((np.diff(place) > 1) | (np.diff(w.row[place]) > 0)) + 1
    breaks = np.concatenate([[0], breaks, [len(place)]])
    ends = len(ids) + np.arange(len(breaks))
    return np.insert(ids, breaks, ends), np.insert(place, breaks, -1)


def _same_words(w: W.Words, h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    _, first, ids = np.unique(h[place], return_index=True, return_inverse=True)
    mine, other = place, place[first][ids]
    size = w.end[mine] - w.start[mine]
    same = size == w.end[other] - w.start[other]
    at, todo = 0, np.flatnonzero(same)
    padded = np.concatenate([w.data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    while len(todo):
        left = np.minimum(size[todo] - at, 8)
        unlike = eight[w.start[mine[todo]] + at] ^ eight[w.start[other[todo]] + at]
        bad = (unlike << ((8 - left) * 8).astype(np.uint64)) != 0
        same[todo[bad]] = False
        at += 8
        todo = todo[~bad]
        todo = todo[size[todo] > at]
    if same.all():
        return ids.astype(np.int64)
    known: dict[bytes, int] = {}  # two words with one hash
    return np.array([known.setdefault(w.data[w.start[p] : w.end[p]].tobytes(), len(known)) for p in place], dtype=np.int64)


def suffixes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, common prefix of each suffix and the next) by prefix doubling; only undecided groups are sorted again."""
    m = len(tokens)
    rank = _dense(tokens)
    order = np.argsort(rank, kind="stable")
    begins = np.searchsorted(rank[order], np.arange(rank.max() + 1))
    rank = begins[rank]  # a class is named by its first place in the order
    levels, step = [rank.astype(np.int32)], 1
    while True:
        ordered = rank[order]
        same = np.zeros(m + 1, dtype=bool)
        same[1:m] = ordered[1:] == ordered[:-1]
        todo = np.flatnonzero(same[:-1] | same[1:])
        if not len(todo):
            break
        at = order[todo]
        # every text ends with a token of its own, so a suffix that shares more goes on
        later = rank[np.minimum(at + step, m - 1)]
        sort = np.lexsort((later, ordered[todo]))
        at, later, group = at[sort], later[sort], ordered[todo]
        order[todo] = at
        new = np.ones(len(todo), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (later[1:] != later[:-1])
        rank = rank.copy()
        rank[at] = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
        levels.append(rank.astype(np.int32))
        step *= 2
    i, j, common = order[:-1].copy(), order[1:].copy(), np.zeros(m - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        equal = level[np.minimum(i, m - 1)] == level[np.minimum(j, m - 1)]
        common[equal] += 1 << k
        i[equal] += 1 << k
        j[equal] += 1 << k
    return order, common


def _seeds(order: np.ndarray, common: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(suffix, suffix, place, place, L) of positions that become adjacent at a distance of at most L / 3."""
    links = np.flatnonzero(common >= SEED)
    links = links[np.argsort(-common[links], kind="stable")]
    nodes = np.unique(np.concatenate([links, links + 1]))
    left = np.searchsorted(nodes, links).tolist()
    right = np.searchsorted(nodes, links + 1).tolist()
    suffix = order[nodes].tolist()
    where = place[order[nodes]].tolist()
    at_place = dict(zip(where, suffix, strict=True))
    parent = list(range(len(nodes)))
    members = [[p] for p in where]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y, length in zip(left, right, common[links].tolist(), strict=True):
        a, b = find(x), find(y)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        parent[b], members[b] = a, []
        reach = length // (LEAST_EXPONENT - 1) if length >= 2 * (LEAST_EXPONENT - 1) else 1
        spots = [bisect_left(large, p) for p in small]
        last = len(small) - 1
        for k, (p, i) in enumerate(zip(small, spots, strict=True)):
            if i and (k == 0 or spots[k - 1] != i) and p - large[i - 1] <= reach:
                yield at_place[large[i - 1]], at_place[p], large[i - 1], p, length
            if i < len(large) and (k == last or spots[k + 1] != i) and large[i] - p <= reach:
                yield at_place[p], at_place[large[i]], p, large[i], length
        for p, i in zip(reversed(small), reversed(spots), strict=True):
            large.insert(i, p)


def runs_of(w: W.Words) -> list[tuple[int, int, int]]:
    """(first word, length, period) of the runs of all rows, by first word and period."""
    tokens, place = _tokens(w, w.hashes())
    if not len(tokens):
        return []
    order, common = suffixes(tokens)
    text = tokens.tolist()
    shortest: dict[tuple[int, int], int] = {}
    for i, j, p, q, length in _seeds(order, common, place):
        if text[i - 1] == text[j - 1]:
            continue  # the run begins further left
        period = q - p
        run = (p, period + length)
        if run[1] >= max(LEAST_LENGTH, LEAST_EXPONENT * period):
            shortest[run] = min(period, shortest.get(run, period))
    return sorted((p, n, q) for (p, n), q in shortest.items())


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` has the words that no run contains after its first period, joined by one blank.
    """
    columns = [c for c in docs.columns if c not in RESULT]
    added = (T.LongType(), T.ArrayType(RUN, False), T.StringType())
    schema = T.StructType([*[docs.schema[c] for c in columns], *[T.StructField(n, t) for n, t in zip(RESULT, added, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text, BATCH_BYTES):
                w = W.words(part.column(text), W.BLANK_SEPARATED)
                found = np.array(sorted((p, q, n) for p, n, q in runs_of(w)), dtype=np.int64).reshape(-1, 3)
                start, period, length = found[:, 0], found[:, 1], found[:, 2]
                kept = ~W.covered(len(w.start), start + period, start + length)
                first = w.first()
                at = np.searchsorted(start, first)
                row = np.searchsorted(first, start, side="right") - 1
                structs = pa.StructArray.from_arrays([pa.array(x) for x in (start - first[row], length, period)], fields=[pa.field(n, pa.int64(), False) for n in RUN.names])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), structs)
                arrays = [*[part.column(c) for c in columns], pa.array(np.diff(first), pa.int64()), lists, W.joined(w, kept).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *RESULT])

    needed = [*columns, *([text] if text not in columns else [])]
    return docs.select(*needed).mapInArrow(run, schema)
