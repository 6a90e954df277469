"""WARC archives: a writer of one gzip member per record and a sequential reader."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, small

#: Bytes after which a task begins another archive, and what the reader takes at a time.
ARCHIVE_BYTES = 8 << 20
CHUNK = 1 << 16
#: Payloads from this size on are stored once.
LEAST_SHARED = 100
#: Groups of equal payloads, some 100 bytes each, up to which their table is broadcast; beyond, the join shuffles, and AQE
#: splits the rows of a payload that very many pages have: both sides are plain scans.
BROADCAST_GROUPS = 50_000
DATE = "2024-01-01T00:00:00Z"


def _header(value: str) -> str:
    """A value that stays on its line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(number[1]) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own. A revisit has the response's HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


class CorruptArchive(ValueError):
    """The bytes of an archive are not the records that they say they are."""


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def members(data) -> Iterator[Iterator[bytes]]:
    """The gzip members of an archive, each as decompressed pieces; a member is read to its end before the next."""
    view, at = memoryview(data), 0

    def pieces(unpack) -> Iterator[bytes]:
        nonlocal at
        while not unpack.eof:
            piece = view[at : at + CHUNK]
            if not len(piece):
                raise CorruptArchive("the archive ends inside a member")
            try:
                out = unpack.decompress(piece)
            except zlib.error as e:
                raise CorruptArchive(str(e)) from e
            at += len(piece) - len(unpack.unused_data)
            if out:
                yield out

    while at < len(view):
        member = pieces(zlib.decompressobj(31))
        yield member
        for _ in member:
            pass


def read(data, payloads: bool = True) -> Iterator[dict]:
    """The records of an archive in order: type, page_id, url, refers_to, payload_digest, payload_bytes, payload.

    A record's block is framed by its Content-Length and hashed as it comes; digests that do not match and lengths that
    are not met raise CorruptArchive. A payload is kept only if asked for."""
    for member in members(data):
        buffer = b""
        for piece in member:
            buffer += piece
            if b"\r\n\r\n" in buffer:
                break
        head, found, rest = buffer.partition(b"\r\n\r\n")
        version, fields = _fields(head)
        if not found or not version.startswith("WARC/"):
            raise CorruptArchive("a member holds no record")
        left = int(fields["content-length"])
        block, body, payload_size, kept = hashlib.sha256(), None, 0, []
        http = b""

        def take(piece: bytes) -> None:
            nonlocal body, http, payload_size
            block.update(piece)
            if body is None:
                http += piece
                head, found, piece = http.partition(b"\r\n\r\n")
                if not found:
                    return
                http, body = head, hashlib.sha256()
            body.update(piece)
            payload_size += len(piece)
            if payloads:
                kept.append(piece)

        part, rest = rest[:left], rest[left:]
        take(part)
        left -= len(part)
        for piece in member:
            take(piece[:left])
            rest += piece[left:]
            left -= min(left, len(piece))
        if left or rest != b"\r\n\r\n":
            raise CorruptArchive("a record is not as long as it says")
        if fields["warc-block-digest"] != f"sha256:{block.hexdigest()}":
            raise CorruptArchive("a block does not match its digest")
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        revisit = fields["warc-type"] == "revisit"
        stated = int(_fields(http)[1]["content-length"])
        if not revisit and (body is None or body.hexdigest() != digest or payload_size != stated):
            raise CorruptArchive("a payload does not match its digest")
        yield {
            "type": fields["warc-type"], "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "refers_to": _page(fields.get("warc-refers-to")),
            "payload_digest": digest, "payload_bytes": stated, "payload": b"".join(kept) if payloads and not revisit else None,
        }


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """content: archives of the records of `pages` (page_id, url, html), each some `archive_bytes`, the bytes of a .warc.gz file.

    Of pages with equal payloads of at least 100 bytes that with the smallest page_id is a response and the others revisit it; all
    rows of that page_id are responses, and all rows are where no page_id is known. Null html is an empty payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"), F.sha2(html, 256).alias("digest"))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = small(materialise(shared.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("_digest"), "first"), "payloads"), BROADCAST_GROUPS)
    rows = rows.join(shared, F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0
        for b in batches:
            for k in range(b.num_rows):
                page, url, payload, digest, first = (b.column(c)[k].as_py() for c in range(5))
                parts.append(record(page, url, payload, digest, first, first is not None and first != page))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])

    return rows.mapInArrow(run, "content binary")


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORDS_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives in column `content`; a corrupt archive fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for r in read(content.as_buffer(), payloads):
                    rows.append({"record_type": r["type"]} | {k: r[k] for k in ("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload")})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    return archives.select("content").mapInArrow(run, RECORDS_SQL)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of `pages`, as read back from its archives.

    - A null html is an empty payload; a null page_id or url is left out of the record and comes back null.
    - Rows that repeat a page_id have a record each, under one WARC-Record-ID. An empty table gives no rows.
    - A very long page is one record, written and read in pieces of a task. Columns beside page_id, url and html play no part."""
    archives = materialise(write_archives(pages, archive_bytes), "archives")
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN MIN(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
