"""WARC records in ZIP-packaged archives, written and read by ranges.

An archive is a ZIP file whose members are stored: ``archive/data.warc.gz``
(each record a gzip member of its own), ``indexes/index.cdx`` (a line of JSON per
record: id, offset and length within the archive member) and
``datapackage.json``.  The reader looks for the end-of-central-directory record
(and its ZIP64 locator and record), parses the central directory with ZIP64
extra fields, finds the stored members behind their local headers, reads the
index, and then reads single records by their range; nothing is extracted.

Archives are written in the shared folder, under a name of the task's own and
then renamed, so a task that runs again leaves a whole file; the table of
archives is written before any is read.

Cases: null html is the empty payload; empty payloads are equal like any others;
repeated rows with the smallest id are each a response; null ids come last (a
group of only those has responses alone) and come back as null; an empty table
gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgauge.llm.store import Scratch

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Record bytes after which a task begins another archive; a larger record is an archive by itself.
ARCHIVE_BYTES = 64_000_000
#: Record bytes that are read from an archive at once, if their ranges touch.
READ_BYTES = 4_000_000
#: Parts into which the rows of a frequent payload are spread.
SALTS = 16

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the payload's digest and length alone."""
    clean = "".join(c for c in url or "" if c >= " " and c != "\x7f")
    body = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields; a response's digest and length are those of the payload that was read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this range")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    ident = lambda value: int(value[10:-1]) if value and value != "<urn:page:>" else None
    payload = rest[: int(field["Content-Length"])]
    revisit = field["WARC-Type"] == "revisit"
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and sha1_base32(payload) != digest:
        raise ValueError(f"record {field['WARC-Record-ID']}: the payload is not that of the digest")
    return {
        "page_id": ident(field["WARC-Record-ID"]),
        "url": field["WARC-Target-URI"],
        "payload_bytes": int(field["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": "revisit" if revisit else "response",
        "refers_to": ident(field.get("WARC-Refers-To")),
        "payload": None if revisit else payload,
    }


class ZipWriter:
    """Stored members one after the other on a stream that need not seek back: sizes are known when a member begins."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.entries, self.force64 = out, 0, [], force64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: list[bytes]) -> None:
        crc, size = 0, 0
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
        self.entries.append((name.encode(), crc, size, self.at))
        large = self.force64 or size >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        small = _MAX32 if large else size
        self._write(struct.pack("<4s5H3L2H", b"PK\3\4", 45 if large else 20, 0x800, 0, 0, 0x21, crc, small, small, len(name.encode()), len(extra)) + name.encode() + extra)
        for part in parts:
            self._write(part)

    def close(self) -> None:
        start = self.at
        for name, crc, size, offset in self.entries:
            wide = [x for x in (size, size, offset) if self.force64 or max(size, offset) >= _MAX32]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            s, o = (_MAX32, _MAX32) if wide else (size, offset)
            self._write(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, s, s, len(name), len(extra), 0, 0, 0, 0, o) + name + extra)
        length, n = self.at - start, len(self.entries)
        if self.force64 or start + length >= _MAX32 or n >= _MAX16:
            at = self.at
            self._write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start))
            self._write(struct.pack("<4sLQL", b"PK\6\7", 0, at, 1))
            n, length, start = _MAX16, _MAX32, _MAX32
        self._write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, length, start, 0))


@dataclass
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int


class ZipReader:
    """A ZIP archive read by ranges; read(offset, length) gives bytes."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - _MAX16)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\5\6", 0, end)  # the signature lies in a comment
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP archive")
        n, length, start = struct.unpack_from("<H2L", tail, end + 10)
        if _MAX16 == n or _MAX32 in (length, start):
            locator = read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
            if locator[:4] == b"PK\6\7":
                record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != b"PK\6\6":
                    raise ValueError("no ZIP64 end of central directory where its locator says")
                n, length, start = struct.unpack_from("<3Q", record, 32)
        self.members: dict[str, Member] = {}
        directory, at = read(start, length), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("the central directory ends early")
            method = struct.unpack_from("<H", directory, at + 10)[0]
            packed, full, names, extras, comments = struct.unpack_from("<2L3H", directory, at + 20)
            header = struct.unpack_from("<L", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + names].decode()
            extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
            while k + 4 <= len(extra):
                kind, long = struct.unpack_from("<2H", extra, k)
                if kind == 1:  # ZIP64: only those of the fields that are full, in this order
                    wide, q = extra[k + 4 : k + 4 + long], 0
                    if full == _MAX32:
                        full, q = struct.unpack_from("<Q", wide, q)[0], q + 8
                    if packed == _MAX32:
                        packed, q = struct.unpack_from("<Q", wide, q)[0], q + 8
                    if header == _MAX32:
                        header = struct.unpack_from("<Q", wide, q)[0]
                k += 4 + long
            self.members[name] = Member(name, method, packed, full, header)
            at += 46 + names + extras + comments

    def begin(self, name: str) -> int:
        """Where a stored member's bytes begin: behind its local header, whose extra field is its own."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed; only stored members are read by ranges")
        local = self.read(member.header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        return member.header + 30 + sum(struct.unpack_from("<2H", local, 26))

    def part(self, name: str, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.members[name].size:
            raise ValueError(f"{name} has no such range")
        return self.read(self.begin(name) + offset, length)


def written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The worker's side of ``write``: path, records and bytes of each archive."""
    store, root = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    records, index, size = [], [], 0

    def flush() -> pa.RecordBatch:
        name, raw = f"{uuid.uuid4().hex}.wacz", "\n".join(map(json.dumps, index)).encode()
        with store.open_output_stream(f"{root}/_{name}") as out:
            archive = ZipWriter(out)
            archive.member(DATA, records)
            archive.member(INDEX, [raw])
            archive.member(PACKAGE, [json.dumps({"profile": "data-package", "records": len(index)}).encode()])
            archive.close()
        store.move(f"{root}/_{name}", f"{root}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64()), pa.array([archive.at], pa.int64())], ["path", "records", "bytes"])

    for batch in batches:
        for page, url, html, origin, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
            raw = gzip.compress(warc_record(page.as_py(), url.as_py(), html.as_buffer().to_pybytes() if html.is_valid else b"", origin.as_py(), revisit.as_py()), 1, mtime=0)
            if records and size + len(raw) > ARCHIVE_BYTES:
                yield flush()
                records, index, size = [], [], 0
            index.append({"id": page.as_py(), "offset": size, "length": len(raw)})
            records.append(raw)
            size += len(raw)
    if records:
        yield flush()


def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The worker's side of ``read``: the records of each archive, in ranges of READ_BYTES."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, at = arrow_fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as file:
                archive = ZipReader(lambda o, n, f=file: f.read_at(n, o), file.size())
                lines = archive.part(INDEX, 0, archive.members[INDEX].size).decode().splitlines()
                entries = [json.loads(x) for x in lines]
                k = 0
                while k < len(entries):
                    first, to = entries[k]["offset"], k + 1
                    while to < len(entries) and entries[to]["offset"] + entries[to]["length"] - first <= READ_BYTES:
                        to += 1
                    span = archive.part(DATA, first, entries[to - 1]["offset"] + entries[to - 1]["length"] - first)
                    rows = [parse_record(gzip.decompress(span[e["offset"] - first : e["offset"] - first + e["length"]])) for e in entries[k:to]]
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    k = to


def revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html (binary), refers_to, revisit: of equal payloads that with the smallest id is the response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("digest", F.when(F.length("html") >= least_bytes, F.sha1("html")))
    often = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    often = scratch.keep(often).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(often, ["digest", "salt"], "left")
    revisit = F.coalesce(F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to")), F.lit(False)) & F.col("refers_to").isNotNull()
    return rows.select("page_id", "url", "html", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """path, records, bytes of the archives that were written for pages(page_id, url, html)."""
    folder = f"{scratch.root}/archives"
    rows = revisits(pages, scratch, least_bytes)
    return scratch.keep(rows.mapInArrow(lambda it: written(it, folder), "path string, records long, bytes long"))


def read(archives: DataFrame) -> DataFrame:
    """The records of archives(path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null of revisits)."""
    return archives.select("path").mapInArrow(found, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written to archives and read back."""
    return read(write(pages, Scratch(pages.sparkSession, "warc")))
