"""Near-duplicate classes by ProbMinHash.

A document is the multiset of its runs of five lower-cased words; a run's
weight is its count. In ProbMinHash every weighted element is a Poisson
process of its rate whose arrivals fall on random components; a component
keeps its first arrival, and an element stops as soon as its next arrival is
later than every component's. Two documents agree in a component with
probability equal to their probability Jaccard similarity.

1. Documents with equal words are one text, represented by the smallest doc_id.
2. Components are banded; in every bucket each text is linked to the bucket's
   hub, and links are verified on the whole texts (exact similarity of at
   least ``least``).
3. In buckets that then still hold several classes, the signatures of different
   classes are compared in blocks of bounded size, and close pairs are verified
   the same way. So no similar pair of a bucket is missed, and no bucket is
   expanded into pairs.
4. Classes are the connected components of the verified links.

Null and empty texts are equal texts; other texts without a word are alike
only if equal. A text of one to four words is one run. Repeated rows fall in
one class; a null doc_id is a document of its own and stays; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendwright.llm import words as W
from spendwright.sources.session import materialise

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 28, 4
COMPONENTS = 1024  # of the estimate for texts whose buckets hold several classes
STAR = 64  # members verified beside one copy of their hub's text
BLOCK = 1024


def weighted(column: pa.Array, n: int = WORDS) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, shingle hashes, rows, counts), ordered by row and hash."""
    w = W.words(column, W.ALPHANUMERIC, lower=True)
    h, row = W.shingles(w, n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return w, h[at], row[at], np.diff(np.append(at, len(h))).astype(np.float64)


def probminhash(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """The element kept by each of ``m`` components, for every row (0 where a row has none)."""
    best = np.full(rows * m, np.inf)
    kept = np.zeros(rows * m, dtype=np.uint64)
    time = np.zeros(len(h))
    step = 0x9E3779B97F4A7C15
    i = 1
    while len(h):
        u = W.mix(h ^ np.uint64(i * step % 2**64))
        time = time - np.log1p(-((u >> np.uint64(11)).astype(np.float64) / 2.0**53)) / weight
        slot = row * m + (W.mix(u + np.uint64(0x632BE59BD9B4E019)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        kept[slot[won]] = h[won]
        latest = best.reshape(rows, m).max(axis=1)
        live = time < latest[row]
        h, row, weight, time = h[live], row[live], weight[live], time[live]
        i += 1
    return kept.reshape(rows, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two (sorted hashes, weights)."""
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    below = np.concatenate([[0.0], np.cumsum(x[order])])
    above = np.concatenate([np.cumsum(y[order][::-1])[::-1], [0.0]])
    cut = np.searchsorted(ratio[order], ratio[both], side="right")
    return float((1.0 / (below[cut] / x[both] + above[cut] / y[both])).sum())


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_key, bands): the key of equal words and the band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text):
                w, h, row, weight = weighted(part.column(text))
                first, count = w.first(), part.num_rows
                whole = w.hashes()
                kept = probminhash(h, row, weight, count, BANDS * ROWS)
                bands = W.grams_of_rows(kept.reshape(count, BANDS, ROWS)).view(np.int64)
                keys = []
                for r in range(count):
                    body = whole[first[r] : first[r + 1]].tobytes() or b"\0" + w.data[w.offsets[r] : w.offsets[r + 1]].tobytes()
                    keys.append(xxhash.xxh3_128_digest(body))
                has_words = np.diff(first) > 0
                at = pa.array(np.arange(count + 1, dtype=np.int32) * BANDS)
                lists = pa.ListArray.from_arrays(at, pa.array(bands.ravel()))
                lists = pa.compute.if_else(pa.array(has_words), lists, pa.scalar([], lists.type))
                arrays = [part.column(key), pa.array(keys, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "text_key", "bands"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "doc long, text_key binary, bands array<long>")


def estimates(docs: DataFrame) -> DataFrame:
    """(doc, signature) of (doc, text): one byte for each of ``COMPONENTS`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", 500_000):
                _, h, row, weight = weighted(part.column("text"))
                kept = probminhash(h, row, weight, part.num_rows, COMPONENTS)
                small = (W.mix(kept) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([s.tobytes() for s in small], pa.binary())], names=["doc", "signature"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, signature binary")


def _verify(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Of (a, b) pairs those whose texts are similar.

    ``docs`` has doc and text. The text of ``a`` is read once per ``STAR``
    pairs: a group is a few texts, whatever the number of pairs of one ``a``.
    """
    pairs = materialise(pairs, "near-pairs")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"))
    dealt = materialise(dealt, "near-dealt")
    asked = dealt.select("a", "g", F.lit(1).alias("role"), F.col("b").alias("doc")).unionByName(
        dealt.select("a", "g").distinct().select("a", "g", F.lit(0).alias("role"), F.col("a").alias("doc"))
    )
    rows = asked.join(docs, "doc").repartition("a", "g").sortWithinPartitions("a", "g", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for part in W.slices(batch, "text"):
                _, h, row, weight = weighted(part.column("text"))
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                a, role, doc = (part.column(c).to_pylist() for c in ("a", "role", "doc"))
                found: list[tuple[int, int, float]] = []
                for r in range(part.num_rows):
                    mine = h[at[r] : at[r + 1]], weight[at[r] : at[r + 1]]
                    if role[r] == 0:
                        head = mine
                    else:
                        s = similarity(head, mine)
                        if s >= least:
                            found.append((a[r], doc[r], s))
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["a", "b", "similarity"])

    return materialise(rows.mapInArrow(run, "a long, b long, similarity double"), "near-links")


def components(links: DataFrame, label: str = "near-labels") -> DataFrame:
    """(doc, class) for every document of the (a, b) links; the class is its component's smallest document.

    Labels pass along links and jump to their label's label until nothing
    changes; every round is written, and hubs only meet partial minima.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), label)
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "doc"), label)
    while True:
        near = both.join(labels.withColumnRenamed("doc", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("doc").alias("label"), F.col("label").alias("far"))
        moved = labels.join(near.withColumnRenamed("a", "doc"), "doc").join(jump, "label", "left")
        moved = moved.select("doc", F.least("label", "near", "far").alias("label"), (F.least("label", "near", "far") < F.col("label")).alias("changed"))
        moved = materialise(moved, label)
        labels = moved.select("doc", "label")
        if not moved.where("changed").limit(1).count():
            return labels.withColumnRenamed("label", "class")


def _hubs(bands: DataFrame) -> DataFrame:
    """(bucket, doc, hub) of the buckets with two texts or more.

    A bucket's hub is the member that meets the most texts over all its
    buckets (the smallest of equal ones): an original rather than a copy of it.
    """
    counts = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(bands.join(counts, "bucket"), "near-shared")
    met = shared.groupBy("doc").agg(F.sum(F.col("n") - 1).alias("met"))
    ranked = materialise(shared.join(met, "doc"), "near-ranked")
    most = ranked.groupBy("bucket").agg(F.max("met").alias("met"))
    hubs = ranked.join(most, ["bucket", "met"]).groupBy("bucket").agg(F.min("doc").alias("hub"))
    return materialise(ranked.join(hubs, "bucket").select("bucket", "doc", "hub"), "near-stars")


def _left_over(stars: DataFrame, labels: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(a, b) pairs of one bucket and different classes whose signatures are close.

    Only buckets that hold several classes are looked at, in blocks of ``BLOCK``
    signatures. The bound lies four standard deviations of the estimate below
    ``least``; one byte agrees by chance in one case of 256.
    """
    low = least - 4 * (least * (1 - least) / COMPONENTS) ** 0.5
    low += (1 - low) / 256
    members = stars.select("bucket", "doc").join(labels, "doc", "left").select("bucket", "doc", F.coalesce("class", "doc").alias("class"))
    members = materialise(members, "near-members")
    stats = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("set"))
    # buckets of several bands with the same members are looked at once
    stats = stats.where("low < high").groupBy("n", "set").agg(F.min("bucket").alias("bucket"))
    sides = stats.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = materialise(members.join(sides, "bucket"), "near-placed")
    wanted = materialise(placed.select("doc").distinct(), "near-wanted")
    # the (at most BANDS) buckets of a text: a pair is given in the smallest bucket that both have
    listed = placed.groupBy("doc").agg(F.collect_set("bucket").alias("buckets"))
    known = materialise(estimates(docs.join(wanted, "doc")).join(listed, "doc"), "near-estimates")
    placed = placed.join(known, "doc")
    placed = placed.withColumn("i", F.pmod(F.xxhash64("doc", F.lit(7)), F.col("blocks")).cast("int"))
    rows = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "doc", "class", "signature", "i", "buckets")
    parts = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def pairs(key: tuple[int, int, int], group: list[tuple]) -> Iterator[tuple[int, int]]:
        bucket, x, y = key
        doc = np.array([g[0] for g in group])
        label = np.array([g[1] for g in group])
        sig = np.frombuffer(b"".join(g[2] for g in group), dtype=np.uint8).reshape(len(group), -1)
        for r in range(len(group) - 1):
            other = np.flatnonzero(label[r + 1 :] != label[r]) + r + 1
            for k in other[(sig[other] == sig[r]).mean(axis=1) >= low].tolist():
                here = x == y or group[r][3] != group[k][3]  # pairs inside a block come from its own group
                if here and min(group[r][4] & group[k][4]) == bucket:
                    yield min(doc[r], doc[k]), max(doc[r], doc[k])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def found() -> pa.RecordBatch:
            columns = list(zip(*pairs(key, group), strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "x", "y", "doc", "class", "signature", "i", "buckets")]
            for bucket, x, y, doc, label, sig, block, buckets in zip(*columns, strict=True):
                if (bucket, x, y) != key:
                    if len(group) > 1:
                        yield found()
                    key, group = (bucket, x, y), []
                group.append((doc, label, sig, block, frozenset(buckets)))
        if len(group) > 1:
            yield found()

    return parts.mapInArrow(compare, "a long, b long").distinct()


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest doc_id of its class) and ``text_id`` (of the equal texts)."""
    signed = materialise(signatures(docs.where(F.col(key).isNotNull()), key, text), "near-signatures")
    equal = signed.groupBy("text_key").agg(F.min("doc").alias("text_id"))
    belongs = materialise(signed.select("doc", "text_key").join(equal, "text_key").select("doc", "text_id"), "near-equal")
    texts = materialise(signed.join(belongs.where("doc = text_id").select("doc").distinct(), "doc", "left_semi"), "near-texts")
    bodies = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))

    bands = texts.select("doc", F.posexplode("bands").alias("band", "value")).select("doc", F.xxhash64("band", "value").alias("bucket"))
    stars = _hubs(bands)
    # only texts that share a bucket are read again: they are picked once, before any join moves texts
    sharing = materialise(stars.select("doc").distinct(), "near-sharing")
    bodies = materialise(bodies.join(sharing, "doc", "left_semi"), "near-bodies")
    pairs = stars.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    links = _verify(pairs, bodies, least)
    more = _verify(_left_over(stars, components(links), bodies, least), bodies, least)
    labels = components(reduce(DataFrame.unionByName, [links, more]))
    out = belongs.join(labels.select(F.col("doc").alias("text_id"), "class"), "text_id", "left")
    return out.select(F.col("doc").alias("doc_id"), F.coalesce("class", "text_id").alias("class_id"), "text_id").unionByName(
        docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("text_id"))
    )
