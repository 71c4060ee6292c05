"""WARC archives: a writer and a sequential reader.

One gzip member per record. The writer puts a ``response`` record per page, or a
``revisit`` record where a page repeats a payload that another page holds. The
reader inflates member by member with an incremental zlib object, frames the
block by ``Content-Length`` and checks block and payload digests.

Files are opened with ``pyarrow.fs`` by the URI of the shared folder. A task
writes files under names of its own, and only the files of successful attempts
are named in the manifest, which Spark commits; a lost executor leaves files
that nothing reads.

Rows: a null or empty ``html`` is an empty payload; a null ``url`` gives no
``WARC-Target-URI``, and one of any length is kept (a header ends where its record
ends at the latest); a null ``page_id`` is written as ``null`` and never referred
to; rows that repeat the largest ``page_id`` of a payload are all responses; an
empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.shared import shared_path, stored

#: Payloads below this size are never deduplicated.
MIN_REVISIT_BYTES = 1000
#: A task starts a new archive once its file has this size.
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """A damaged archive: bad gzip, framing or digest."""


# ------------------------------------------------------------------ records as bytes


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def encode_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = deflate.compress(f"{head}Content-Length: {len(block)}\r\n\r\n".encode())
    return data + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The response record of a page, or the revisit record that names another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [
        ("WARC-Payload-Digest", _digest(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", _digest(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return encode_record(fields, block)


def warcinfo_record() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return encode_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], block)


# ------------------------------------------------------------------ sequential reader


def members(source: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file, each as an iterator over inflated chunks.

    A member must be read to its end before the next one is asked for.
    """
    pending = source.read(CHUNK)
    while pending:
        inflate = zlib.decompressobj(31)

        def chunks(inflate=inflate) -> Iterator[bytes]:
            nonlocal pending
            while True:
                try:
                    out = inflate.decompress(pending, CHUNK)
                except zlib.error as e:
                    raise WarcError(f"bad gzip member: {e}") from e
                pending = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out
                if inflate.eof:
                    pending = pending or source.read(CHUNK)
                    return
                if not pending:
                    pending = source.read(CHUNK)
                    if not pending:
                        raise WarcError("the file ends within a record")

        yield chunks()


class Block:
    """Exact reads from one record's inflated chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.rest = chunks, b""

    def until(self, mark: bytes) -> bytes:
        head, at = bytearray(self.rest), -1
        while (at := head.find(mark, max(0, at))) < 0:
            more = next(self.chunks, None)
            if more is None:
                raise WarcError("record ends within its header")
            at = len(head) - len(mark) + 1
            head += more
        self.rest = bytes(head[at + len(mark) :])
        return bytes(head[:at])

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.rest:
                self.rest = next(self.chunks, b"")
                if not self.rest:
                    raise WarcError("record is shorter than its Content-Length")
            part, self.rest = self.rest[:n], self.rest[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _check(name: str, want: str | None, got: bytes) -> None:
    if want is not None and want != _digest(got):
        raise WarcError(f"{name} digest does not match")


def _page_of(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def read_records(source: BinaryIO, payloads: bool = True) -> Iterator[tuple]:
    """Rows of ``RECORDS`` from an archive, in file order.

    With ``payloads`` false, bodies are hashed as they stream by and never kept.
    The payload length of a revisit is the Content-Length of its HTTP header.
    """
    for chunks in members(source):
        block = Block(chunks)
        version, field = _fields(block.until(b"\r\n\r\n"))
        if not version.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {version[:20]!r}")
        try:
            length = int(field["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no Content-Length") from e
        kind, whole, body, size = field.get("warc-type"), hashlib.sha1(), hashlib.sha1(), 0
        kept, head, http = [], bytearray(), None
        for part in block.exactly(length):
            whole.update(part)
            if kind not in ("response", "revisit"):
                continue
            if http is None:
                seen = max(0, len(head) - 3)
                head += part
                if (at := head.find(b"\r\n\r\n", seen)) < 0:
                    continue
                http, part = _fields(bytes(head[:at]))[1], bytes(head[at + 4 :])
            body.update(part)
            size += len(part)
            if payloads:
                kept.append(part)
        if block.rest + b"".join(chunks) != b"\r\n\r\n":
            raise WarcError("record is longer than its Content-Length")
        _check("block", field.get("warc-block-digest"), whole.digest())
        if kind not in ("response", "revisit"):
            continue
        if http is None:
            raise WarcError("no HTTP header")
        stated = int(http.get("content-length", size))
        digest = field.get("warc-payload-digest")
        if kind == "response":
            if stated != size:
                raise WarcError("payload is not as long as its HTTP header says")
            _check("payload", digest, body.digest())
        raw = base64.b32decode(digest[5:]) if digest else body.digest()
        yield (
            _page_of(field.get("warc-record-id")), field.get("warc-target-uri"), stated, raw.hex(), kind,
            _page_of(field.get("warc-refers-to")), b"".join(kept) if payloads and kind == "response" else None,
        )


# ------------------------------------------------------------------ Spark


def _open(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


def _archives(batches: Iterable[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    out, row, rows = None, None, []

    def close():
        nonlocal out
        out.close()
        rows.append(tuple(row))
        out = None

    for batch in batches:
        for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
            if out is None:
                uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs, path = _open(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out, row = fs.open_output_stream(path, compression=None), [uri, 0, 0]
                row[2] += out.write(warcinfo_record())
            row[2] += out.write(page_record(page_id, url, (html or "").encode(), refers_to))
            row[1] += 1
            if row[2] >= archive_bytes:
                close()
    if out is not None:
        close()
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()))],
        ["path", "n_records", "n_bytes"],
    )


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` with ``refers_to``: the page whose equal payload stands for this one.

    The payload groups are aggregated map-side and written; the join back has
    only plain exchanges below it, so that Spark can split a payload that holds
    a large share of all pages.
    """
    page = pages.select("page_id", "url", F.col("html")).withColumns(
        {"digest": F.sha1(F.coalesce("html", F.lit("")).cast("binary")), "n": F.octet_length(F.coalesce("html", F.lit("")))}
    )
    repeated = (
        page.filter(F.col("n") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .filter("copies > 1 and keeper is not null")
        .drop("copies")
    )
    repeated = stored(repeated, "warc-payloads")
    refers = F.when((F.col("n") >= min_bytes) & (F.coalesce(F.col("page_id") < F.col("keeper"), F.lit(True))), F.col("keeper"))
    return page.join(repeated, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; the stored manifest."""
    rows = revisits(pages, min_revisit_bytes)
    return stored(rows.mapInArrow(lambda b: _archives(b, folder, archive_bytes), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of ``RECORDS`` from the archives that a manifest names, one archive a task at a time."""
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = _open(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for row in read_records(source, payloads):
                        rows.append(row)
                        size += len(row[-1] or b"")
                        if len(rows) >= 4096 or size >= 1 << 24:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    n_files = max(1, manifest.count())
    return manifest.select("path").repartition(n_files).mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write archives below the shared folder and read them back, without bodies."""
    return read_archives(write_archives(pages, shared_path(spark, "warc")), payloads=False)
