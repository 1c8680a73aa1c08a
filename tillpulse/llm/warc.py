"""Web archives: a writer of gzip-member WARC records and a sequential reader.

Writing: each task writes its records to one archive file in a shared folder, one gzip member per record, and reports the
file; the reports are a written table, so that only files of committed attempts count, whatever executors were lost.
Records whose payload another record already holds are written as revisits without the payload. Which record holds it is
settled by an aggregate over digests; payloads go through one shuffle, from which the adaptive join can split a digest with
very many copies.

Reading: each archive is read from front to back in blocks. zlib decompresses incrementally, a new member begins where
the last one ended, the content length frames the record, and digests are verified. Memory is one record and one block.

Cases: a null payload is empty; payloads below ``LEAST_REVISIT`` bytes are always written out; of equal payloads the one
with the largest id (a null id is the smallest) is the response; rows that repeat that id, and equal payloads of which none
has an id, are each a response in full, as in the SQL check; an empty table writes no archive and reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import map_batches, stored
from tillpulse.session import shared_dir

LEAST_REVISIT = 1000
BLOCK = 1 << 16
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


class BrokenArchive(ValueError):
    """A record whose framing or digest is wrong."""


def digest_header(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def digest_hex(header: str) -> str:
    kind, _, value = header.partition(":")
    if kind.lower() != "sha1":
        raise BrokenArchive(f"unknown digest {header}")
    return base64.b32decode(value).hex()


def record_uri(page_id: int | None, serial: str = "") -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}{serial}>"


def uri_page(uri: str) -> int | None:
    value = uri.rpartition(":")[2].rstrip(">")
    return None if value == "none" else int(value)


def gzip_member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id, url, payload: bytes, sha1_hex: str, refers_to, is_revisit: bool) -> bytes:
    """A response record with the payload, or a revisit record with its digest and length only. Line breaks in a url are
    percent-encoded, because a header is one line."""
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Date", _DATE),
        *([("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url is not None else []),
        ("WARC-Payload-Digest", digest_header(sha1_hex)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    if is_revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(refers_to))]
    head += [("WARC-Block-Digest", digest_header(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    return gzip_member(head, block)


class Record(NamedTuple):
    headers: dict[str, str]  # names in lower case
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _header_lines(head), body


def _header_lines(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}


def members(stream: BinaryIO, block: int = BLOCK) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, read in blocks."""
    unread = stream.read(block)
    while unread:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not unread:
                raise BrokenArchive("the archive ends inside a member")
            parts.append(unpacker.decompress(unread))
            unread = unpacker.unused_data if unpacker.eof else stream.read(block)
        yield b"".join(parts)
        unread = unread or stream.read(block)


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive in order, their framing and block digests verified."""
    for member in members(stream):
        head, gap, rest = member.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"WARC/"):
            raise BrokenArchive("a member does not begin with a record header")
        headers = _header_lines(head)
        length = int(headers["content-length"])
        block, end = rest[:length], rest[length:]
        if len(block) != length or end != b"\r\n\r\n":
            raise BrokenArchive(f"record {headers.get('warc-record-id')} is not as long as its header says")
        stated = headers.get("warc-block-digest")
        if stated and hashlib.sha1(block).hexdigest() != digest_hex(stated):
            raise BrokenArchive(f"record {headers.get('warc-record-id')} does not have its digest")
        yield Record(headers, block)


_LOWEST = -(1 << 63)


def deduplicated(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): ``refers_to`` is set where another row holds the same payload."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    holders = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("copies")
    )
    holders = stored(holders.where("copies > 1").select("digest", "holder"), "payload-holders")
    is_revisit = F.coalesce("page_id", F.lit(_LOWEST)) < F.col("holder")
    return rows.join(holders, "digest", "left").withColumn("refers_to", F.when(is_revisit, F.col("holder"))).drop("holder")


def open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` (default: a fresh shared one); (path, records) per archive."""
    folder = folder or shared_dir(pages.sparkSession, "archives")

    def write(batches):
        files, at = open_folder(folder)
        files.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        records, out = 0, None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            out = out or files.open_output_stream(f"{at}/{name}", compression=None)
            for page_id, url, payload, digest, refers_to in zip(*columns):
                page = page_id.as_py()
                out.write(page_record(page, url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), refers_to.is_valid))
                records += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records])], ["path", "records"])

    return stored(map_batches(deduplicated(pages, least), write, "path string, records long"), "archive-list")


def _rows(stream: BinaryIO, with_payload: bool) -> Iterator[tuple]:
    for record in read_records(stream):
        kind = record.headers["warc-type"]
        http, payload = record.http()
        digest, length = digest_hex(record.headers["warc-payload-digest"]), int(http["content-length"])
        refers_to = record.headers.get("warc-refers-to")
        if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
            raise BrokenArchive(f"the payload of {record.headers['warc-record-id']} does not have its length and digest")
        yield (
            uri_page(record.headers["warc-record-id"]), record.headers.get("warc-target-uri"), kind, length, digest,
            refers_to and uri_page(refers_to), payload if with_payload and kind == "response" else None,
        )


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) per record of the archives listed in
    ``archives`` (path, records). The payload of a revisit is null: it is that of the response it refers to."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def read(batches):
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                files, at = open_folder(path)
                rows, size, seen = [], 0, 0
                with files.open_input_stream(at, compression=None) as stream:
                    for row in _rows(stream, with_payload):
                        rows.append(row)
                        size += len(row[-1] or b"") + 100
                        seen += 1
                        if size >= 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
                if seen != expected:
                    raise BrokenArchive(f"{path} has {seen} records, {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    each = archives.select("path", "records").repartition(max(1, archives.count()))
    return map_batches(
        each, read,
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary",
    )
