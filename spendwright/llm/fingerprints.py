"""Document fingerprints: bottom-k sketches of word shingle hashes, in SQL functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a
text's runs of five words (a shorter text, if not empty, is one shingle).
Sketches of parts merge to the sketch of the whole (:func:`merge`), and give
estimates of resemblance, containment and the number of distinct shingles.

Null texts count as empty: the empty sketch. Two empty sketches resemble each
other fully, an empty and a non-empty one not at all. Equal texts have equal
sketches. Ties in the document order go by text; null ids come last; repeated
rows stay rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
RANGE_BYTES = 8 << 20
MOST_RANGES = 65_535


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    """Bottom-k sketch of a text's shingles."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: _smallest(_shingles(h, n), k))[0]


def _shingles(h: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(n)]))
    short = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))))
    return F.when(F.size(h) >= n, runs).otherwise(short)


def _smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together (their shingles pooled)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the two shingle sets, 0 to 1."""
    both, union = F.array_intersect(a, b), F.least(F.size(F.array_union(a, b)), F.lit(k))
    # of the union's bottom k only those up to its largest count
    top = F.element_at(merge(a, b, k), -1)
    inside = F.size(F.filter(both, lambda h: h <= top))
    return F.when(union == 0, F.lit(1.0)).otherwise(inside / union)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while fewer than ``k``."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The sketch as 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``: a binary search (null: none)."""
    bits = len(cuts).bit_length()
    if not bits:
        return F.lit(0)
    filled = cuts + [2**63 - 1] * ((1 << bits) - len(cuts))
    array = F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")

    def step(low: Column, half: Column) -> Column:
        return low + F.when(F.element_at(array, low + half) <= key, half).otherwise(0)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), step)


def with_next(docs: DataFrame, value: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of (doc_id, text, ``value``) with ``next``: text and value of the next document.

    The order is by descending doc_id, then text; the last is followed by the
    first. Rows are dealt to ranges of doc_id by cut points, the first row of
    each range is added to the range before it, and a window inside each range
    finds the next row. So rows move once, and no task holds more than a range.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text") + 1000)).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(1, -(-size // range_bytes))))
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges))).first()[0] or []))
    dealt = docs.withColumn("range", F.coalesce(_range_of(F.col("doc_id"), cuts), F.lit(0)))
    heads = {r["range"]: r["doc_id"] for r in dealt.groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()}
    order = sorted(heads, reverse=True)
    follows = [(r, heads[order[(i + 1) % len(order)]]) for i, r in enumerate(order)]  # at most MOST_RANGES of them
    listed = F.broadcast(spark.createDataFrame(follows, "to_range int, head long"))
    added = docs.join(listed, F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", value, F.col("to_range").alias("range"), F.lit(True).alias("is_head"))
    rows = dealt.select("doc_id", "text", value, "range", F.lit(False).alias("is_head")).unionByName(added)
    by = Window.partitionBy("range").orderBy("is_head", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("next", F.lead(F.struct("text", value)).over(by)).where(~F.col("is_head")).drop("range", "is_head")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketches of every text, of its edited text, and their likenesses.

    The edited text has the last third of the characters replaced by the first
    as many of the next document. Columns: doc_id, text, edited, sketch,
    edited_sketch, near_edited, near_next.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch(F.col("text"), k)), "sketch")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    rows = rows.select("doc_id", "text", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k))
    near = resemblance(F.col("sketch"), F.col("edited_sketch"), k), resemblance(F.col("sketch"), F.col("next_sketch"), k)
    return rows.select("doc_id", "text", "edited", "sketch", "edited_sketch", near[0].alias("near_edited"), near[1].alias("near_next"))
