"""Substring deduplication of bytes with suffix arrays.

Every byte is removed that lies in a string of ``WINDOW`` bytes which also starts
in a document with a smaller doc_id.

1. Each string has an anchor, the ``GRAM`` bytes in it with the smallest hash.
   Anchors that two documents have are found from their hashes alone, dealt to
   tasks by range of the hash, which is mixed again for it: as the smallest of
   many, the hashes themselves crowd the lowest range. Equal strings have equal
   anchors, so the rest of the text can hold no repeat.
2. Documents are dealt to shards of bounded size. A shard sorts the suffixes of
   its stretches around recurring anchors (Larsson and Sadakane's refinement:
   only undecided groups are sorted again, by the ranks that one and, where they
   fit, two sorted lengths away have reached) and takes the common prefixes of neighbours in text order
   (Kasai). Strings with a common prefix of ``WINDOW`` form a class; only those
   of the class's first document are sent on, as stretches that share an anchor,
   in suffix order.
3. Stretches of all shards meet by anchor. The sorted lists are merged by binary
   search. A string with ``o`` bytes before its anchor is told from others by the
   class of what stands from the anchor on, to depth ``WINDOW - o``, and of what
   stands before it, to depth ``o``; both are compared as bytes. The strings that
   a smaller doc_id has are told to their shards.
4. The shards remove what is covered.

All this is one job, so the texts are shuffled once and read three times. Lists
of numbers travel byte by byte of all numbers, ascending ones as differences.

An anchor with more than ``hot`` places would gather in one task. Its strings
are dealt one by one by their own hash instead: equal ones meet, at most one of
each shard. Hashes only select and deal; what is removed was compared.

Null and empty texts have no bytes. A null doc_id counts as larger than any
other; rows that share a doc_id are not earlier than one another. Texts are
taken whole; a shard with a text larger than ``shard_bytes`` holds that text
with about forty times its size. Rows equal in id and text go to one shard. An
empty table gives no rows. Other columns pass through; those named like a
result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwright.llm import words as W

WINDOW, GRAM = 50, 24
SHARD_BYTES, SLICE_BYTES = 4 << 20, 1 << 17
#: text bytes for each task that merges anchors, and for each that merges stretches
RANGE_BYTES, MERGE_BYTES = 16 << 20, 4 << 20
HOT = 20_000
#: bits of an anchor's hash that are kept
HASH_BITS = 48
RESULT = ("n_bytes", "n_removed", "n_spans", "kept")
_LAST = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 30) - 1)
_MIX = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)), (np.uint64(31), np.uint64(1)))
_SPANS = "shard long, start binary, end binary"


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, their first bytes side by side, then their second ones and so on."""
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def _numbers(squeezed: pa.Scalar, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(squeezed.as_buffer()), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _ascending(numbers: np.ndarray) -> bytes:
    """Ascending hashes compressed."""
    return _squeezed(np.diff(numbers, prepend=np.uint64(0)))


def _hashes(squeezed: pa.Scalar) -> np.ndarray:
    return np.cumsum(_numbers(squeezed, np.uint64), dtype=np.uint64)


def _eight(data: np.ndarray, more: int = 64) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers, zeros after the end."""
    padded = np.concatenate([data, np.zeros(more + 8, dtype=np.uint8)])
    return np.ndarray((len(data) + more,), dtype="<u8", buffer=padded.data, strides=(1,))


def _hashed(eight: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    begin = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    h: np.ndarray | None = None
    for b in begin:
        part = eight[b:][at] if isinstance(at, slice) else eight[at + b]
        if h is None:
            h = part + np.uint64(size)
        else:
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += part
        for shift, factor in _MIX:
            h ^= h >> shift
            h *= factor
    return h


class Windows:
    """Strings of ``WINDOW`` bytes inside the rows of a buffer, with the place of the anchor of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.eight = _eight(data)
        until = np.repeat(offsets[1:], np.diff(offsets))
        self.start = np.flatnonzero(np.arange(n) + WINDOW <= until)
        if not len(self.start):
            self.at = self.start
            return
        # smallest hash, then first place: high bits of the hash over the place
        least = (_hashed(self.eight, slice(n), GRAM) & ~_PLACE) | (np.arange(n, dtype=np.uint64) & _PLACE)
        span, wanted = 1, WINDOW - GRAM + 1
        while span < wanted:
            step = min(span, wanted - span)
            np.minimum(least[:-step], least[step:], out=least[:-step])
            span += step
        self.at = (least[self.start] & _PLACE).astype(np.int64)
        if n > int(_PLACE):  # places beyond 30 bits
            self.at += (self.start - self.at + int(_PLACE)) // (int(_PLACE) + 1) * (int(_PLACE) + 1)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return W.mix(_hashed(self.eight, at, GRAM)) >> np.uint64(64 - HASH_BITS)


def _windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start and anchor of each string, first string of each anchor, its hash) of row slices, which bounds the arrays."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        low = offsets[first]
        w = Windows(data[low : offsets[last]], offsets[first : last + 1] - low)
        if len(w.at):
            begin = np.flatnonzero(np.diff(w.at, prepend=-1))
            yield w.start + low, w.at + low, begin, w.hashes(w.at[begin])
        first = last


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``text`` by the ``depth`` bytes (or somewhat more) from there on."""
    m = len(text)
    key = _eight(text)[:m].byteswap()  # as numbers in the order of the bytes
    order = np.argsort(key).astype(np.int64)
    ordered = key[order]
    new = np.ones(m, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(m, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    step, times = 8, 3 if (m + 1) ** 3 < 1 << 63 else 2  # as many ranks as one number holds
    while step < depth:
        ordered = rank[order]
        same = np.zeros(m + 1, dtype=bool)
        same[1:m] = ordered[1:] == ordered[:-1]
        todo = np.flatnonzero(same[:-1] | same[1:])
        if not len(todo):
            break
        at, all_ = order[todo], ordered[todo]
        later = np.concatenate([rank + 1, np.zeros(2 * step, dtype=np.int64)])
        for k in range(1, times):
            all_ = all_ * (m + 1) + later[at + k * step]
        sort = np.argsort(all_)
        at, all_ = at[sort], all_[sort]
        order[todo] = at
        step *= times
        if step < depth:
            new = np.ones(len(todo), dtype=bool)
            new[1:] = all_[1:] != all_[:-1]
            rank[at] = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lane: int = 128) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, at most ``most``; 0 for the first.

    In text order a common prefix is at most one shorter than the last (Kasai); many
    stretches of the text are walked side by side. After a prefix of ``most`` nothing
    is carried on, as the order need not tell such suffixes apart.
    """
    m = len(text)
    eight = _eight(text, most + 8)
    before = np.full(m, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    found = np.zeros(m, dtype=np.int64)
    begin = np.arange(0, m, lane)
    h = np.zeros(len(begin), dtype=np.int64)
    for t in range(min(lane, m)):
        if begin[-1] + t >= m:
            begin, h = begin[:-1], h[:-1]
        i = begin + t
        j = before[i]
        h = np.where(h < most, np.maximum(h - 1, 0), 0)
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            unlike = eight[i[todo] + h[todo]] ^ eight[j[todo] + h[todo]]
            equal = np.bitwise_count((unlike & (~unlike + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            h[todo] += equal
            todo = todo[(equal == 8) & (h[todo] < most)]
        h = np.where(j >= 0, np.minimum(h, most), 0)
        found[i] = h
    return found[order]


def _packed(docs: DataFrame, columns: list[str], key: str, text: str, shards: int) -> DataFrame:
    """``docs`` with compressed ``_body`` instead of the text, dealt to shards by id and text."""
    source = docs.select(*[F.col(c) for c in columns if c != text], F.col(key).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
    source = source.withColumn("_deal", F.xxhash64("_doc", "_text"))
    names = [c for c in source.columns if c != "_text"]
    schema = T.StructType([*[source.schema[c] for c in names], T.StructField("_body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            bodies = [press.compress(t.as_buffer()) if t.is_valid else None for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(bodies, pa.binary())], names=[*names, "_body"])

    return source.mapInArrow(run, schema).withColumn("_shard", F.pmod("_deal", F.lit(shards)))


_TEXTS = ["_deal", "_doc", "_body"]


def _opened(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(rows in a fixed order, doc of each, bytes of all texts, offsets)."""
    rows = rows.take(pc.sort_indices(rows, [("_deal", "ascending"), ("_doc", "ascending")])) if rows.num_rows else rows
    W.give_back()
    open_ = zstandard.ZstdDecompressor()
    bodies = [open_.decompress(b.as_buffer()) if b.is_valid else b"" for b in rows.column("_body").combine_chunks()]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies], dtype=np.int64)]).astype(np.int64)
    doc = rows.column("_doc").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
    return rows, doc, np.frombuffer(b"".join(bodies), dtype=np.uint8), offsets


def _anchors(ranges: int):
    """(range, shard, hashes, places and rows of each) of a shard's anchors."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, _, data, offsets = _opened(rows.select(_TEXTS))
        found = [(h, at[begin]) for _, at, begin, h in _windows(data, offsets)]
        h = np.concatenate([np.zeros(0, np.uint64), *[f[0] for f in found]])
        row = np.searchsorted(offsets, np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]]), side="right") - 1
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(begin, len(h)))
        many = np.maximum.reduceat(row, begin) != np.minimum.reduceat(row, begin) if len(h) else np.zeros(0, dtype=bool)
        h, about = h[begin], (2 * size + many).astype(np.uint32)
        cuts = np.searchsorted(h, np.array([-(-(r << HASH_BITS) // ranges) for r in range(1, ranges)], dtype=np.uint64)) if ranges > 1 else np.zeros(0, dtype=np.int64)
        made = [(r, _ascending(a), _squeezed(b)) for r, (a, b) in enumerate(zip(np.split(h, cuts), np.split(about, cuts), strict=True)) if len(a)]
        return pa.table({"part": pa.array([m[0] for m in made], pa.int32()), "shard": pa.array([key[0].as_py()] * len(made), pa.int64()), "hashes": pa.array([m[1] for m in made], pa.binary()), "about": pa.array([m[2] for m in made], pa.binary())})

    return run


def _recurring(hot: int):
    """(shard, hashes, hot) of the anchors of a range that two rows have."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        W.give_back()
        lists = [_hashes(b) for b in rows.column("hashes").combine_chunks()]
        about = np.concatenate([_numbers(b, np.uint32) for b in rows.column("about").combine_chunks()])
        h = np.concatenate(lists)
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        size = np.diff(np.append(begin, len(h)))
        about = about[order].astype(np.int64)
        again = (size > 1) | (np.bitwise_or.reduceat(about, begin) & 1 > 0)
        wide = np.add.reduceat(about >> 1, begin) > hot
        keep, is_hot = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
        keep[order], is_hot[order] = np.repeat(again, size), np.repeat(wide, size)
        at = np.cumsum([0, *[len(x) for x in lists]])
        out = [(s, _ascending(h[a:b][keep[a:b]]), _squeezed(is_hot[a:b][keep[a:b]])) for s, a, b in zip(rows.column("shard").to_pylist(), at, at[1:]) if keep[a:b].any()]
        return pa.table({"shard": pa.array([o[0] for o in out], pa.int64()), "hashes": pa.array([o[1] for o in out], pa.binary()), "hot": pa.array([o[2] for o in out], pa.binary())})

    return run


def _spans(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of what the windows at the given places cover, joined where these are neighbours."""
    start = np.sort(start)
    new = np.diff(start, prepend=-2) > 1
    return start[new], start[np.append(new[1:], True)] + WINDOW if len(start) else start


def _stretches(merges: int):
    """A shard's own repeats (``part`` below 0) and its stretches for others, by the task that merges them."""

    def run(key: tuple, rows: pa.Table, recurring: pa.Table) -> pa.Table:
        W.give_back()
        _, doc, data, offsets = _opened(rows.select(_TEXTS))
        known = np.concatenate([np.zeros(0, np.uint64), *[_hashes(b) for b in recurring.column("hashes").combine_chunks()]])
        is_hot = np.concatenate([np.zeros(0, bool), *[_numbers(b, bool) for b in recurring.column("hot").combine_chunks()]])
        made = [_local(key[0].as_py(), doc, data, offsets, known, is_hot, merges)] if len(known) and len(data) else []
        if not made:
            return pa.table({f.name: pa.array([], f.type) for f in _FOUND})
        return pa.Table.from_pylist(made[0], schema=_FOUND)

    return run


_FOUND = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("start", pa.binary()), ("end", pa.binary()), ("docs", pa.binary()), ("before", pa.binary()), ("more", pa.binary()), ("body", pa.binary())])


def _local(shard: int, doc: np.ndarray, data: np.ndarray, offsets: np.ndarray, known: np.ndarray, is_hot: np.ndarray, merges: int) -> list[dict]:
    sort = np.argsort(known)
    known, is_hot = known[sort], is_hot[sort]
    parts = []
    for start, at, begin, anchor in _windows(data, offsets):
        place = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        size = np.diff(np.append(begin, len(at)))
        chosen = np.repeat(known[place] == anchor, size)
        parts.append((start[chosen], at[chosen], np.repeat(place, size)[chosen]))
    start, at, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    if not len(start):
        return []
    anchor, hot = known[place], is_hot[place]
    del parts, place
    # the stretches alone, with the places of strings and anchors in them
    inside = W.covered(len(data), *_spans(start))
    text = data[inside]
    moved = np.cumsum(inside) - 1
    begin, middle = moved[start], moved[at]
    del inside, moved
    order = suffix_order(text, WINDOW)
    group = np.empty(len(text), dtype=np.int64)
    group[order] = np.cumsum(common_prefixes(text, order, WINDOW) < WINDOW)
    group = group[begin]
    rank = np.empty(len(text), dtype=np.int64)
    rank[order] = np.arange(len(text))
    del order
    mine = doc[np.searchsorted(offsets, start, side="right") - 1]
    first = np.full(int(group.max()) + 1, _LAST, dtype=np.int64)
    np.minimum.at(first, group, mine)
    later = mine > first[group]
    a, b = _spans(start[later])
    out = [{"shard": shard, "part": -1 - shard, "start": a.tobytes(), "end": b.tobytes()}]
    # strings of a class's first document, joined where they are neighbours with one anchor
    stay = np.flatnonzero(~later)
    start, begin, middle, anchor, hot, mine = start[stay], begin[stay], middle[stay], anchor[stay], hot[stay], mine[stay]
    middle = np.where(hot, begin, middle)
    eight = _eight(text)
    deal = np.where(hot, _hashed(eight, begin, WINDOW), W.mix(anchor)) if hot.any() else W.mix(anchor)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (np.diff(start) != 1) | (np.diff(middle) != 0)
    lead = np.flatnonzero(new)
    more = np.diff(np.append(lead, len(start))) - 1
    part = (deal[lead] % np.uint64(merges)).astype(np.int64)
    sort = np.lexsort((rank[middle[lead]], part))
    lead, more, part = lead[sort], more[sort], part[sort]
    before = middle[lead] - begin[lead]
    size = before + WINDOW
    ends = np.cumsum(size)
    padded = np.concatenate([text, np.zeros(WINDOW, dtype=np.uint8)])
    index = np.repeat(begin[lead] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    body = padded[index]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, dtype=np.int64)
    press = zstandard.ZstdCompressor(level=1)
    byte = np.concatenate([[0], ends])
    for x, y in zip(edges, edges[1:]):
        out.append(
            {
                "shard": shard,
                "part": int(part[x]),
                "start": _squeezed(start[lead[x:y]]),
                "docs": _squeezed(mine[lead[x:y]]),
                "before": _squeezed(before[x:y].astype(np.uint8)),
                "more": _squeezed(more[x:y].astype(np.uint8)),
                "body": press.compress(body[byte[x] : byte[y]].tobytes()),
            }
        )
    return out


def _merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of (strings, numbers) as one, two by two, places found by binary search."""
    while len(lists) > 1:
        out = []
        for (a, x), (b, y) in zip(lists[::2], lists[1::2]):
            at = np.searchsorted(a, b, side="right") + np.arange(len(b))
            other = np.ones(len(a) + len(b), dtype=bool)
            other[at] = False
            keys, numbers = np.empty(len(other), dtype=a.dtype), np.empty(len(other), dtype=np.int64)
            keys[at], numbers[at], keys[other], numbers[other] = b, y, a, x
            out.append((keys, numbers))
        lists = out + ([lists[-1]] if len(lists) % 2 else [])
    return lists[0]


def _depths(keys: np.ndarray) -> np.ndarray:
    """Common prefix of each fixed-size string with the one before; -1 for the first."""
    width = keys.dtype.itemsize
    chars = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), width)
    out = np.full(len(keys), -1, dtype=np.int64)
    unlike = chars[1:] != chars[:-1]
    out[1:] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    return out


def _earlier(key: tuple, rows: pa.Table) -> pa.Table:
    """(shard, spans) of strings that a document of another shard with a smaller id has; a shard's own repeats as they are."""
    if key[0].as_py() < 0:
        return rows.select(["shard", "start", "end"])
    W.give_back()
    open_ = zstandard.ZstdDecompressor()
    get = lambda c, kind: [_numbers(b, kind) for b in rows.column(c).combine_chunks()]
    starts, befores, mores = get("start", np.int64), get("before", np.uint8), get("more", np.uint8)
    docs = np.concatenate(get("docs", np.int64))
    reach = WINDOW - GRAM
    lists, left, count = [], [], 0
    for packed, before in zip(rows.column("body").combine_chunks(), befores, strict=True):
        body = np.frombuffer(open_.decompress(packed.as_buffer()), dtype=np.uint8)
        before = before.astype(np.int64)
        middle = np.cumsum(before + WINDOW) - WINDOW
        right = body[middle[:, None] + np.arange(WINDOW)]
        at = middle[:, None] - 1 - np.arange(reach)
        left.append(np.where(np.arange(reach) < before[:, None], body[np.maximum(at, 0)], 0).astype(np.uint8))
        lists.append((np.ascontiguousarray(right).view(f"S{WINDOW}").ravel(), count + np.arange(len(before))))
        count += len(before)
    keys, number = _merged(lists)
    del lists
    depth, own = _depths(keys), np.empty(count, dtype=np.int64)
    own[number] = np.arange(count)
    del keys
    keys = np.ascontiguousarray(np.concatenate(left)).view(f"S{reach}").ravel()
    left_order = np.argsort(keys)
    left_depth = _depths(keys[left_order])
    left_own = np.empty(count, dtype=np.int64)
    left_own[left_order] = np.arange(count)
    before, more = np.concatenate(befores).astype(np.int64), np.concatenate(mores).astype(np.int64)
    start = np.concatenate(starts)
    gone, holder = [], []
    for o in range(reach + 1):
        has = np.flatnonzero((before >= o) & (before - more <= o))
        if not len(has):
            continue
        right = np.cumsum(depth < WINDOW - o)[own[has]]
        both = np.cumsum(left_depth < o)[left_own[has]] * (count + 1) + right
        sort = np.argsort(both, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], both[sort][1:] != both[sort][:-1]]))
        least = np.minimum.reduceat(docs[has][sort], begin)
        late = np.zeros(len(has), dtype=bool)
        late[sort] = np.repeat(least, np.diff(np.append(begin, len(has)))) < docs[has][sort]
        gone.append(start[has[late]] + before[has[late]] - o)
        holder.append(has[late])
    gone, holder = np.concatenate(gone), np.concatenate(holder)
    edges = np.cumsum([0, *[len(s) for s in starts]])
    sort = np.argsort(holder, kind="stable")
    gone, cuts = gone[sort], np.searchsorted(holder[sort], edges)
    out = []
    for shard, x, y in zip(rows.column("shard").to_pylist(), cuts, cuts[1:]):
        if y > x:
            a, b = _spans(gone[x:y])
            out.append({"shard": shard, "start": a.tobytes(), "end": b.tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([("shard", pa.int64()), ("start", pa.binary()), ("end", pa.binary())]))


def _cut(columns: list[str], text: str, wanted: list[str]):
    """The rows of a shard without the bytes in its spans."""

    def run(_key: tuple, rows: pa.Table, spans: pa.Table) -> pa.Table:
        rows, _, data, offsets = _opened(rows)
        places = [np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(b.as_buffer(), dtype=np.int64) for b in spans.column(c).combine_chunks()]]) for c in ("start", "end")]
        gone = W.covered(len(data), *places)
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, gone & ~before)]
        removed, spans_of = (np.diff(s[offsets]) for s in sums)
        kept = W.masked(data, offsets, ~gone, pa.large_binary()).cast(pa.binary())
        made = {"n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans_of, pa.int64()), "kept": kept}
        if text in columns:
            whole = W.masked(data, offsets, np.ones(len(data), dtype=bool), pa.large_string()).cast(pa.string())
            made[text] = pc.if_else(rows.column("_body").combine_chunks().is_valid(), whole, pa.scalar(None, pa.string()))
        return pa.table([made[c] if c in made else rows.column(c) for c in wanted], names=wanted)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining bytes.

    The text column is left out with ``keep_text=False``.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    shards, ranges, merges = (max(1, -(-size // x)) for x in (shard_bytes, RANGE_BYTES, MERGE_BYTES))
    columns = [c for c in docs.columns if c not in RESULT and (keep_text or c != text)]
    private = {c: f"_c{i}" for i, c in enumerate(columns) if c != text}  # no name of ours can meet one of theirs
    renamed = docs.select(*[F.col(c).alias(p) for c, p in private.items()], F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_source"))
    full = _packed(renamed, list(private.values()), "_key", "_source", shards)
    bodies = full.groupBy("_shard")
    anchors = bodies.applyInArrow(_anchors(ranges), "part int, shard long, hashes binary, about binary")
    recurring = anchors.groupBy("part").applyInArrow(_recurring(hot), "shard long, hashes binary, hot binary")
    schema = "shard long, part long, start binary, end binary, docs binary, before binary, more binary, body binary"
    found = bodies.cogroup(recurring.groupBy("shard")).applyInArrow(_stretches(merges), schema)
    spans = found.groupBy("part").applyInArrow(_earlier, _SPANS)
    wanted = [*private.values(), *(["_source"] if text in columns else []), *RESULT]
    kinds = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept": T.BinaryType(), "_source": T.StringType()}
    out = T.StructType([T.StructField(c, kinds.get(c) or full.schema[c].dataType) for c in wanted])
    cut = bodies.cogroup(spans.groupBy("shard")).applyInArrow(_cut(wanted, "_source", wanted), out)
    return cut.select(*[F.col(private.get(c, "_source")).alias(c) for c in columns], *RESULT)
