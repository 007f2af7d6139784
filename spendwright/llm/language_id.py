"""Language identification by compression.

A language is a raw-content zstandard dictionary of its sample text. A text is
compressed once per language; the language whose dictionary gives the fewest
bytes wins, and a narrow margin over the runner-up rejects the text.

Long texts are compressed in blocks that all start from the dictionary, and the
sizes of all blocks add up, so the whole text counts. The fit reads a bounded
sample (``texts_per_language`` excerpts of ``excerpt_chars``); scoring is one
Arrow pass without a shuffle.

Null texts and texts without a letter give ``und`` with score 0 and are not
accepted. The language's own code length (its share among the labelled rows)
counts as well, so equal sizes go to the more frequent language, then to the
alphabetically first. Repeated rows are scored like any other; an empty table gives no rows;
other columns pass through, and a column with a result's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UND = "und"
LEVEL = 5
_LETTER = re.compile(r"[^\W\d_]")
#: lower-cased ASCII letters and all bytes of other characters stay, the rest becomes blanks
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_BLANKS = re.compile(rb" {2,}")
RESULT = ("lang_pred", "score", "margin_bytes", "accepted")


def normalise(text: str) -> bytes:
    """Lower-cased letters, everything else as single blanks."""
    return _BLANKS.sub(b" ", text.lower().encode("utf-8", "replace").translate(_KEEP)).strip()


def fit(
    rows: DataFrame, text: str = "text", lang: str = "lang", texts_per_language: int = 300, excerpt_chars: int = 1500, dictionary_bytes: int = 110_000
) -> dict[str, tuple[bytes, float]]:
    """(dictionary, share of the rows) by language, from a bounded sample of labelled rows.

    The sample is chosen by a hash of the text: the same rows at every
    partitioning, spread over the corpus. An excerpt starts at a hashed place.
    A dictionary is the first ``dictionary_bytes`` of its excerpts, in the order
    of their hash: with the defaults about a hundred of them fill it, the others
    make up for short ones.
    """
    labelled = rows.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * texts_per_language / n))).otherwise(share)
    uniform = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - excerpt_chars, F.lit(1))) + 1
    sample = labelled.where(uniform < share).select("lang", F.xxhash64("text").alias("h"), F.substring("text", start.cast("int"), F.lit(excerpt_chars)).alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = sample.dropDuplicates(["lang", "h"]).withColumn("n", order).where(F.col("n") <= texts_per_language)
    parts: dict[str, list[bytes]] = {}
    for r in chosen.orderBy("lang", "n").collect():
        parts.setdefault(r["lang"], []).append(normalise(r["text"]))
    total = sum(counts.values())
    return {name: (b" ".join(p)[:dictionary_bytes], counts[name] / total) for name, p in parts.items() if b"".join(p)}


class Scorer:
    """Compressed sizes of texts under every language's dictionary."""

    def __init__(self, dictionaries: dict[str, tuple[bytes, float]], level: int = LEVEL, block_bytes: int = 8192, per_byte: float = 0.5):
        self.names = sorted(dictionaries)
        self.block, self.per_byte = block_bytes, per_byte
        self.label_bytes = np.array([-np.log2(dictionaries[name][1]) / 8 for name in self.names])
        self.compressors = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, body: bytes) -> np.ndarray:
        """Bytes under each dictionary, over all blocks (cut at blanks where there are any)."""
        total, at = np.zeros(len(self.names), dtype=np.int64), 0
        while at < len(body):
            end = min(at + self.block, len(body))
            if end < len(body):
                blank = body.rfind(b" ", at + 1, end)
                end = blank if blank > at else end
            part = body[at:end]
            total += [len(c.compress(part)) for c in self.compressors]
            at = end
        return total

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """(language, score, bytes between the two smallest sizes)."""
        if not self.names or not text or not _LETTER.search(text):
            return UND, 0.0, 0
        sizes = self.sizes(normalise(text))
        best = int((sizes + self.label_bytes).argmin())
        above = sizes + self.label_bytes - sizes[best] - self.label_bytes[best]
        score = 1.0 / float(np.exp(-self.per_byte * above).sum())
        margin = int(np.delete(sizes, best).min() - sizes[best]) if len(sizes) > 1 else int(sizes[best])
        return self.names[best], score, margin


def identify(docs: DataFrame, dictionaries: dict[str, tuple[bytes, float]], text: str = "text", least_margin: int = 1, level: int = LEVEL) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin_bytes`` and ``accepted``.

    ``accepted`` is false for ``und`` and where the two smallest sizes are less
    than ``least_margin`` bytes apart. The dictionaries are broadcast: their
    size is a parameter of :func:`fit` times the number of languages.
    """
    kept = [c for c in docs.columns if c not in RESULT]
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin_bytes", T.LongType()), T.StructField("accepted", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, level)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(text).to_pylist()]
            names, scores, margins = ([f[i] for f in found] for i in range(3))
            accepted = [n != UND and m >= least_margin for n, m in zip(names, margins, strict=True)]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.int64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *RESULT])

    return docs.select(*kept).mapInArrow(score, schema)
