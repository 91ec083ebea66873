"""Write web pages as WARC archives and read them back as a chunked record table.

Writing. A payload longer than ``SEGMENT`` bytes is cut into a first record and ``continuation`` records, as the format
provides, so that no line of an archive is longer than a segment and its header. Records whose payload of at least
``MIN_REVISIT`` bytes equals that of a record with a smaller id become ``revisit`` records that name it and hold no
payload. Archives are written by Spark's own text writer (gzip), one per task, into any folder Spark can write to.

Reading. Each task streams its archives line by line through a small state machine that yields rows
``record_id, chunk_no, data, ...`` of at most ``CHUNK`` bytes, with the SHA-256 of the payload up to and including the
chunk; a payload is never put together in memory. The last chunk of a record is marked and carries the full digest,
which is held against the header's.

Defined cases: a null payload is empty; equal page ids with equal payloads are the same record, so each is a response;
a null page id sorts after all others and is read back as null; a null url leaves out the target, line breaks in
it are percent-encoded; no pages, no records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairground.llm.registry import query
from fairground.session import scratch_folder

SEGMENT = 1 << 20
CHUNK = 1 << 18
MIN_REVISIT = 100
EOL = "\r\n"
CHUNK_SCHEMA = (
    "page_id long, segment int, chunk_no int, data binary, digest string, last boolean, payload_bytes long, "
    "record_type string, refers_to long, url string, digest_ok boolean"
)


def _header(kind: str, fields: list[tuple[str, Column]], length: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}")]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), length.cast("string"), F.lit(EOL + EOL))


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Pages with ``body`` (binary), ``digest`` (SHA-256) and ``first_id``, the smallest key of an equal payload.

    Keys and digests alone are grouped (map-side first, so a payload that a third of all pages share is no hot
    group); pages then meet only the digests that occur more than once, where Spark may split a skewed partition.
    """
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.withColumn("body", body).withColumn("digest", F.sha2("body", 256))
    repeated = rows.where(F.octet_length("body") >= MIN_REVISIT).groupBy("digest").agg(
        F.min(key).alias("first_id"), F.count("*").alias("n")
    ).where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id")
    return rows.join(repeated, "digest", "left")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str = "url", date: Column | None = None) -> None:
    """Write one WARC record per page, and continuation records for what exceeds a segment. ``date``: when the pages
    were captured, a timestamp (the time of writing where it isn't given, or null)."""
    utc = F.to_utc_timestamp(F.current_timestamp() if date is None else F.coalesce(date, F.current_timestamp()), F.current_timezone())
    stamp = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = with_revisits(pages.select(F.col(key).alias("page_id"), F.col(payload).alias("html"), F.col(url).alias("url"), stamp.alias("date")))
    captured = ("WARC-Date", F.col("date"))
    is_copy = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    size = F.octet_length("body")
    n_segments = F.when(is_copy, 1).otherwise(F.greatest(F.lit(1), F.ceil(size / SEGMENT).cast("int")))
    rows = rows.select("*", size.alias("size"), n_segments.alias("n_segments"))
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("n_segments"))))
    part = F.expr(f"substring(body, (segment - 1) * {SEGMENT} + 1, {SEGMENT})")
    many = F.col("n_segments") > 1
    copy = _header("revisit", [
        ("WARC-Record-ID", record), captured, ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        ("X-Payload-Length", F.col("size")),
    ], F.lit(0))
    first = _header("response", [
        ("WARC-Record-ID", record), captured, ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest),
        ("X-Payload-Length", F.col("size")), ("WARC-Segment-Number", F.when(many, F.lit(1))),
    ], F.octet_length("part"))
    later = _header("continuation", [
        ("WARC-Record-ID", F.concat(F.lit("<urn:page-segment:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("segment").cast("string"), F.lit(">"))),
        captured, ("WARC-Segment-Origin-ID", record), ("WARC-Segment-Number", F.col("segment")),
        ("WARC-Segment-Total-Length", F.when(F.col("segment") == F.col("n_segments"), F.col("size"))),
    ], F.octet_length("part"))
    header = F.when(is_copy, copy).when(F.col("segment") == 1, first).otherwise(later)
    rows = rows.withColumn("part", F.when(is_copy, F.lit(b"")).otherwise(part))
    # the writer ends the line; with the one here that is the empty line that ends a record
    line = F.concat(F.encode(header, "UTF-8"), F.col("part"), F.lit(EOL.encode())).cast("string").alias("value")
    rows.select(line).write.option("lineSep", EOL).option("compression", "gzip").text(folder)


class _Archive:
    """The state machine of one archive: takes its lines in order, gives chunk rows."""

    def __init__(self) -> None:
        self.head: dict[bytes, bytes] | None = None  # None: between records
        self.left = -1  # bytes of the block still to come, -1 in the header
        self.page: list = []

    def lines(self, lines: Iterator[bytes]) -> Iterator[tuple]:
        for line in lines:
            if self.left > 0 or (self.left == 0 and self.head is not None):
                # inside the block; a line break inside the payload is two bytes of it
                take = line[: self.left]
                self.left -= len(take)
                yield from self._data(take)
                if self.left >= 2 or (self.left > 0):
                    end = EOL.encode()[: self.left]
                    self.left -= len(end)
                    yield from self._data(end)
                elif self.left == 0:
                    self.head = None
                    yield from self._end()
            elif self.left < 0 and self.head is not None and not line:
                self.left = int(self.head.get(b"content-length", b"0"))
                yield from self._begin()
            elif self.head is not None:
                name, _, value = line.partition(b":")
                self.head[name.strip().lower()] = value.strip()
            elif line.startswith(b"WARC/"):
                self.head, self.left = {}, -1

    def _begin(self) -> Iterator[tuple]:
        head = self.head
        kind = head.get(b"warc-type", b"").decode()
        self.segment = int(head.get(b"warc-segment-number", b"1"))
        self.closed = b"warc-segment-number" not in head
        if kind == "continuation":
            self.closed = b"warc-segment-total-length" in head
        else:
            ref = head.get(b"warc-refers-to")
            self.page = [_page(head[b"warc-record-id"]), kind, _page(ref) if ref else None, head.get(b"warc-target-uri")]
            self.declared = head.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:")
            self.length = int(head.get(b"x-payload-length", b"0"))
            self.sha, self.seen, self.chunk = hashlib.sha256(), 0, 0
            self.buffer = bytearray()
        return iter(())

    def _data(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while len(self.buffer) > CHUNK:
            yield self._row(bytes(self.buffer[:CHUNK]), False)
            del self.buffer[:CHUNK]

    def _end(self) -> Iterator[tuple]:
        if self.closed:
            yield self._row(bytes(self.buffer), True)
            self.buffer = bytearray()

    def _row(self, data: bytes, last: bool) -> tuple:
        self.sha.update(data)
        self.seen += len(data)
        page, kind, ref, url = self.page
        digest, size = self.sha.hexdigest(), self.seen
        ok = None
        if last and kind == "revisit":
            digest, size = self.declared, self.length
        elif last:
            ok = digest == self.declared and size == self.length
        row = (page, self.segment, self.chunk, data, digest, last, size, kind, ref, url.decode() if url else None, ok)
        self.chunk += 1
        return row


def _page(urn: bytes) -> int | None:
    number = urn.strip(b"<>").rpartition(b":")[2]
    return None if number == b"null" else int(number)


_ARROW = pa.schema([
    ("page_id", pa.int64()), ("segment", pa.int32()), ("chunk_no", pa.int32()), ("data", pa.binary()),
    ("digest", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("digest_ok", pa.bool_()),
])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held, archive, current = [], 0, None, None
    for batch in batches:
        value, path = batch.column(0), batch.column(1)
        lines = value.to_pylist()
        paths = path.to_pylist()
        start = 0
        while start < len(lines):
            if paths[start] != current:
                current, archive = paths[start], _Archive()
            end = start
            while end < len(lines) and paths[end] == current:
                end += 1
            for row in archive.lines(iter(lines[start:end])):
                rows.append(row)
                held += len(row[3]) + 200
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows, held = [], 0
            start = end
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk rows of all archives in a folder. A gzip file is never split, so a task sees whole archives in order."""
    lines = spark.read.option("lineSep", EOL).text(folder)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"))
    return lines.mapInArrow(_read, CHUNK_SCHEMA)


@query("op10_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, CASE WHEN first < page_id THEN NULL ELSE true END AS digest_ok
FROM f""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Archive every page, read the archives back, one row per record."""
    folder = scratch_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf}/pages.parquet"), folder)
    chunks = read_archives(spark, folder)
    return chunks.where("last").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "digest_ok"
    )
