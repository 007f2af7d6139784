"""WARC archives: writing pages as records, and reading them with segment reassembly.

Writing: one response record per payload, a revisit record (profile
identical-payload-digest) for every other page with the same payload. The
record block is an HTTP response whose body is in chunked transfer coding; a
block longer than ``segment_bytes`` is cut into a first record and
continuation records that carry the origin's id, their number and, in the
last one, the total length. Records are written as text rows with the record
separator as line separator, so Spark's own writer makes the archive files
(one gzip member each).

Reading: files, plain or gzip with any number of members (archives commonly
hold one per record), are parsed by Content-Length, continuation records are
grouped by origin identifier, ordered by segment number and their total length
is verified; then the chunked framing is decoded. Archives of other writers
are read as well: their record ids are the keys, a response or resource
without an HTTP head is its own payload, and records of other types (warcinfo,
request, metadata) have none.

Null payloads count as empty; null URLs become empty targets. Among equal
payloads the largest page id is the response, all others revisit it. Repeated
page ids give repeated records. An empty table gives no rows. Truncated records,
missing or repeated segments, a wrong total and broken chunks raise ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendwright.sources.session import materialise

SEPARATOR = "\r\n\r\n"
#: ``page:<id>``; segments after the first add ``:<number>``
_URN = "<urn:page:{}>"
_PARTS = "record_type string, record_id string, refers_to string, payload_digest string, origin_id string, segment long, total long, block binary"


def base32_sha1(payload: bytes) -> str:
    """The payload digest as WARC states it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_of_hex(digest: Column) -> Column:
    """A hex SHA-1 in base 32, as an expression: five hex digits are four base-32 digits."""

    def four(i: int) -> Column:
        value = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.concat(*[four(i) for i in range(8)])


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """``payload`` in chunked transfer coding."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is not whole")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, name: str, url: str, block: bytes, more: list[tuple[str, object]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", _URN.format(name)), ("WARC-Date", "2024-01-01T00:00:00Z")]
    head += [("WARC-Target-URI", re.sub(r"[\r\n]", "", url)), *more, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block


def records(name: str, url: str, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the separator that follows each."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    http_type = ("Content-Type", "application/http; msgtype=response")
    stated = ("WARC-Payload-Digest", f"sha1:{digest}")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record("revisit", name, url, http, [http_type, stated, profile, ("WARC-Refers-To", _URN.format(refers_to))])
        return
    block = http + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record("response", name, url, block, [http_type, stated])
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record("response", name, url, parts[0], [http_type, stated, ("WARC-Segment-Number", 1)])
    for i, part in enumerate(parts[1:], 2):
        more: list[tuple[str, object]] = [("WARC-Segment-Origin-ID", _URN.format(name)), ("WARC-Segment-Number", i)]
        if i == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield _record("continuation", f"{name}:{i}", url, part, more)


def inflate(raw: bytes) -> bytes:
    """The content of a plain or gzip archive; all members of the latter."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    parts = []
    while raw:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(raw))
        if not member.eof:
            raise ValueError("gzip member is not whole")
        raw = member.unused_data.lstrip(b"\0")  # zero padding may follow the last member
    return b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive's bytes."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("record header is not whole")
        lines = data[at:head].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin = head + 4
        end = begin + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("record is not whole")
        yield fields, data[begin:end]
        at = end + 4


def choose(pages: DataFrame, payload: str = "html", key: str = "page_id", least_bytes: int = 0) -> DataFrame:
    """(key, digest, refers_to) of the pages that revisit another one.

    Groups by digest and length with partial aggregation; payloads below
    ``least_bytes`` are never revisits.
    """
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    light = pages.select(F.col(key), F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= least_bytes)
    shared = light.groupBy("digest", "n").agg(F.max(key).alias("response"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    return light.join(shared, ["digest", "n"]).where(F.col(key) < F.col("response")).select(key, "digest", F.col("response").alias("refers_to"))


def write(
    pages: DataFrame, path: str, payload: str = "html", url: str = "url", key: str = "page_id", segment_bytes: int = 16_384, records_per_file: int = 4000
) -> None:
    """Write the pages as gzip archives below ``path`` (one compressed member a file)."""
    # written first: its size is then known, and the pages are shuffled only if it is large
    revisits = materialise(choose(pages, payload, key).distinct(), "warc-revisits")
    digest = F.sha1(F.encode(F.coalesce(payload, F.lit("")), "UTF-8")).alias("digest")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"), digest)
    rows = rows.join(revisits.withColumnRenamed(key, "key"), ["key", "digest"], "left")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, urls, payloads, digests, refers = (batch.column(c).to_pylist() for c in ("key", "url", "payload", "digest", "refers_to"))
            out: list[bytes] = []
            for k, u, p, d, r in zip(keys, urls, payloads, digests, refers, strict=True):
                stated = base64.b32encode(bytes.fromhex(d)).decode()
                out += records(str(k), u or "", (p or "").encode(), stated, None if r is None else str(r), segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = rows.select("key", "url", "payload", "digest", "refers_to").mapInArrow(make, "record binary")
    writer = made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def read_parts(spark, path: str) -> DataFrame:
    """Every record of the archives below ``path``, segments not yet joined."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("record_type", "record_id", "refers_to", "payload_digest", "origin_id", "segment", "total", "block")
        types = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in parse(inflate(content.as_py())):
                    number = f.get("warc-segment-number")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((f["warc-type"], f["warc-record-id"], f.get("warc-refers-to"), digest, f.get("warc-segment-origin-id"), number and int(number), f.get("warc-segment-total-length") and int(f["warc-segment-total-length"]), block))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(split, _PARTS)


def reassemble(parts: DataFrame) -> DataFrame:
    """One row per record: continuation blocks joined to their origin's, the total length verified.

    Only records in segments are shuffled; their group is one record.
    """
    segmented = F.col("segment").isNotNull()
    whole = parts.where(~segmented).select("record_type", "record_id", "refers_to", "payload_digest", "block")
    origin = F.coalesce("origin_id", "record_id").alias("origin")
    groups = parts.where(segmented).groupBy(origin).agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "record_id", "refers_to", "payload_digest")],
    )
    numbers = F.col("s.segment")
    # a binary cast to string keeps its bytes as they are
    joined = F.array_join(F.transform(F.col("s.block"), lambda b: b.cast("string")), "").cast("binary")
    in_order = numbers == F.sequence(F.lit(1).cast("long"), F.size("s").cast("long"))
    length = F.aggregate(F.col("s.block"), F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b))
    fine = in_order & (length == F.col("total")) & F.col("record_id").isNotNull()
    block = F.when(fine, joined).otherwise(F.raise_error(F.concat(F.lit("segments are not whole: "), F.col("origin"))).cast("binary"))
    return whole.unionByName(groups.select("record_type", "record_id", "refers_to", "payload_digest", block.alias("block")))


def _payload(block: bytes) -> bytes:
    """The body of an HTTP response, or a block that is none as it is."""
    if not block.startswith(b"HTTP/"):
        return block
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP header is not whole")
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def read(spark, path: str) -> DataFrame:
    """Records of the archives: ``key``, ``record_type``, ``refers_to``, ``stated_digest``, ``payload``; revisits have no payload.

    ``key`` and ``refers_to`` are page ids in archives of :func:`write`, and record ids as they stand in others.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for kind, block in zip(batch.column("record_type").to_pylist(), batch.column("block"), strict=True):
                payloads.append(_payload(block.as_py()) if kind in ("response", "resource") else None)
            columns = [batch.column(c) for c in ("record_type", "record_id", "refers_to", "payload_digest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(payloads, pa.binary())], names=["record_type", "record_id", "refers_to", "stated_digest", "payload"])

    schema = "record_type string, record_id string, refers_to string, stated_digest string, payload binary"
    found = reassemble(read_parts(spark, path)).select("record_type", "record_id", "refers_to", "payload_digest", "block").mapInArrow(decode, schema)
    name = lambda c: F.regexp_replace(c, r"(?s)^<urn:page:(.*)>$", "$1")
    return found.select(name("record_id").alias("key"), "record_type", name("refers_to").alias("refers_to"), "stated_digest", "payload")
