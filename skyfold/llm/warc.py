"""WARC archives written and read as chunks.

A page becomes one WARC record; a payload that was seen before becomes a revisit of
the record that holds it. A long payload is written as segments, one row each, so
neither the writer nor the reader holds a record whole. Archives are written by the
text sink (a record ends with two line breaks, which is its separator) and each
gzip file is read back by one task as a stream: the reader cuts the stream by the
records' lengths and emits rows of record id and chunk number that carry the digest
of the payload so far.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm.common import slices, split_join
from skyfold.session import checkpoint_dir

BREAK = "\r\n\r\n"
#: Characters of a segment.
SEGMENT_CHARS = 262_144
#: Bytes of a chunk row.
CHUNK_BYTES = 65_536
#: Date of every record unless the pages bring their own; fixed, so a rerun writes the same archives.
DATE = "2024-01-01T00:00:00Z"

CHUNKS = (
    "page_id long, chunk_no int, is_last boolean, record_type string, refers_to long, "
    "payload binary, payload_bytes long, payload_digest string"
)


def digest_of(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's UTF-8 bytes."""
    digest = F.sha1(payload.cast("binary"))
    # five hex digits are four base32 digits
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lpad(F.conv(F.substr(digest, k * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.array_join(groups, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``, a row for each page.

    Of pages with equal payloads of at least ``min_bytes`` bytes the smallest
    ``page_id`` is the response; rows that repeat this id are responses as well. A
    null html is an empty payload. Null ids come after all others and refer to the
    smallest id, if there is one. The smallest ids are aggregated before they meet
    the pages, and the join's hot payloads can be split.
    """
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), digest_of(payload).alias("payload_digest"),
    )
    keys = ["payload_digest", "payload_bytes"]
    first = rows.groupBy(*keys).agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return split_join(rows, first, keys).select(
        *rows.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the pages as gzip WARC archives below ``path``, long payloads in segments."""
    rows = records(pages, min_bytes)
    stored = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    segment = rows.withColumn("stored", stored).drop("payload").withColumn(
        "segment", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((char_length(stored) - 1) div {SEGMENT_CHARS} as int)"))))
    )
    first = F.col("segment") == 0
    last = F.col("segment") == F.greatest(F.lit(0), F.expr(f"cast((char_length(stored) - 1) div {SEGMENT_CHARS} as int)"))
    part = F.substring(F.col("stored"), F.col("segment") * SEGMENT_CHARS + 1, F.lit(SEGMENT_CHARS))
    http = F.when(first & (F.col("record_type") == "response"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + BREAK)).otherwise("")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(first, F.col("record_type")).otherwise("continuation")),
        F.concat(F.lit("WARC-Record-ID: "), F.when(first, _record_id(F.col("page_id"))).otherwise(
            F.concat(F.lit("<urn:segment:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("segment").cast("string"), F.lit(">")))),
        F.concat(F.lit("WARC-Segment-Number: "), (F.col("segment") + 1).cast("string")),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: "), _record_id(F.col("page_id")))),
        F.when(~last, F.lit("X-More-Segments: yes")),
        F.when(last & ~first, F.concat(F.lit("WARC-Segment-Total-Length: "), (F.col("payload_bytes")).cast("string"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.col("url"), "[\\r\\n]", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(F.col("record_type") == "revisit", F.concat_ws(
            "\r\n", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"))),
            F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(part)).cast("string")),
    )
    segment.select(F.concat(head, F.lit(BREAK), http, part).alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(path)


class _Stream:
    """Cuts one archive's bytes, fed piece by piece, into chunks of payload."""

    def __init__(self, payloads: bool):
        self.payloads = payloads
        self.pending = b""
        self.state, self.left = "head", 0
        self.head: dict[str, str] = {}
        self.page: int | None = None
        self.sha, self.total, self.number = hashlib.sha1(), 0, 0

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.pending += data
        while True:
            if self.state == "head":
                at = self.pending.find(BREAK.encode())
                if at < 0:
                    return
                lines = self.pending[:at].decode().split("\r\n")
                self.pending = self.pending[at + 4 :]
                self.head = dict(line.split(": ", 1) for line in lines[1:])
                self.left = int(self.head["Content-Length"])
                kind = self.head["WARC-Type"]
                if kind != "continuation":
                    self.page = _number(self.head["WARC-Record-ID"])
                    self.sha, self.total, self.number = hashlib.sha1(), 0, 0
                self.state = "http" if kind == "response" else "block"
            elif self.state == "http":
                at = self.pending.find(BREAK.encode())
                if at < 0:
                    return
                self.pending = self.pending[at + 4 :]
                self.left -= at + 4
                self.state = "block"
            elif self.state == "block":
                while self.left > CHUNK_BYTES and len(self.pending) >= CHUNK_BYTES:
                    yield self._chunk(CHUNK_BYTES, False)
                if len(self.pending) < min(self.left, CHUNK_BYTES) or self.left > CHUNK_BYTES:
                    return
                yield self._chunk(self.left, "X-More-Segments" not in self.head)
                self.state = "end"
            else:
                if len(self.pending) < 4:
                    return
                self.pending = self.pending[4:]
                self.state = "head"

    def _chunk(self, size: int, last: bool) -> tuple:
        data, self.pending = self.pending[:size], self.pending[size:]
        self.left -= size
        self.sha.update(data)
        self.total += size
        self.number += 1
        kind = "revisit" if self.head["WARC-Type"] == "revisit" else "response"
        length, digest = self.total, base64.b32encode(self.sha.digest()).decode()
        if kind == "revisit":  # the payload is in the record that it refers to
            length, digest = int(self.head["X-Payload-Length"]), self.head["WARC-Payload-Digest"].removeprefix("sha1:")
        refers = _number(self.head["WARC-Refers-To"]) if kind == "revisit" else None
        return self.page, self.number - 1, last, kind, refers, data if self.payloads else None, length, digest


def _number(record_id: str) -> int | None:
    text = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def read_chunks(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Chunk rows of the archives below ``path``: record id, chunk number and payload, with length and digest so far.

    ``is_last`` marks a record's last chunk, whose length and digest are those of the
    whole payload. A revisit has one chunk without payload that tells the length and
    digest of the payload it refers to. ``payloads=False`` leaves the bytes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream = None, _Stream(payloads)
        for part in slices(batches, 64):
            rows: list[tuple] = []
            for name, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if name != file:
                    file, stream = name, _Stream(payloads)
                else:  # a break stands between lines; a file's last line may end without one
                    line = BREAK.encode() + line
                rows.extend(stream.feed(line))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
            names = ["page_id", "chunk_no", "is_last", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    lines = spark.read.option("lineSep", BREAK).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(run, CHUNKS)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back and return what each record tells."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    last = read_chunks(spark, path, payloads=False).where("is_last")
    return last.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The round trip's result in DuckDB's SQL.
ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id,
             list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)) AS letters FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
