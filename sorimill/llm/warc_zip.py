"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, one
gzip member for each record, and ``indexes/index.cdxj`` with each record's
offset and length. The reader takes the end record and, where it points there,
the ZIP64 end record from the file's tail, parses the central directory with
its ZIP64 fields, finds the stored archive members and their indexes, and reads
records by range. Nothing is extracted, and no file is read whole.

Payloads equal to a larger id's, of at least ``least`` bytes, become revisit
records without a body. Their digests are compared in the cluster; payloads are
moved only if the repeated digests are too many to broadcast. Packages are
written under names of their own into the shared folder, and a manifest table
lists those of the tasks that succeeded: a lost task leaves at most a file that
no manifest names.

Defined cases: a null payload is empty; a null URI leaves the header out; a
null id is smaller than any other and reads back as null; rows that repeat the
largest id are all responses; an empty table gives no packages and no records;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, as_text, cut, null_first_less, shared_dir, small

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
#: Bytes after which a task starts another package.
PACKAGE = 64 << 20
#: Adjacent records read at a time.
READ = 4 << 20

_RECORD = "<urn:sorimill:record:{}>"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored: int
    header: int


# Reading -----------------------------------------------------------------------------------------


def _extra64(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset of a directory entry, those at their limit from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, out = extra[at + 4 : at + 4 + n], []
            for v in values:
                if v == 0xFFFFFFFF:
                    (v,), field = struct.unpack("<Q", field[:8]), field[8:]
                out.append(v)
            return out
        at += 4 + n
    return values


def members(file) -> list[Member]:
    """The central directory of a package; ``file`` has size() and read_at(n, offset)."""
    size = file.size()
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = file.read_at(20, tail_at + end - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator missing")
        (at,) = struct.unpack_from("<Q", locator, 8)
        record = file.read_at(56, at)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record missing")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = file.read_at(length, start), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory entry broken")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        stored, plain = struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, at + 28)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        plain, stored, header = _extra64(extra, [plain, stored, header])
        found.append(Member(name, method, plain, stored, header))
        at += 46 + n_name + n_extra + n_note
    return found


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    local = file.read_at(30, member.header)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("local header broken")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and HTTP payload of one gzipped record."""
    data = zlib.decompress(raw, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a package, by its indexes."""
    found = {m.name: m for m in members(file)}
    for index in sorted(n for n in found if n.startswith("indexes/")):
        at = data_start(file, found[index])
        entries = [json.loads(x.split(b" ", 2)[2]) for x in file.read_at(found[index].stored, at).splitlines()]
        starts = {}
        run: list[dict] = []

        def flush():
            if not run:
                return
            base, first = starts[run[0]["filename"]], int(run[0]["offset"])
            last = int(run[-1]["offset"]) + int(run[-1]["length"])
            raw = file.read_at(last - first, base + first)
            for e in run:
                yield parse_record(raw[int(e["offset"]) - first : int(e["offset"]) - first + int(e["length"])])
            run.clear()

        for e in entries:
            if e["filename"] not in starts:
                starts[e["filename"]] = data_start(file, found[e["filename"]])
            follows = run and run[-1]["filename"] == e["filename"] and int(run[-1]["offset"]) + int(run[-1]["length"]) == int(e["offset"])
            if run and not (follows and int(e["offset"]) + int(e["length"]) - int(run[0]["offset"]) <= READ):
                yield from flush()
            run.append(e)
        yield from flush()


def _id(value: str | None) -> int | None:
    last = (value or "").rstrip(">").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


RECORDS = "id long, record_type string, uri string, refers_to long, payload_digest string, payload_bytes long"


def read_packages(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """One row for each record of the packages in ``manifest`` (path).

    The digest and length of a response are taken from its payload; those of a
    revisit, which has none, from its headers. A payload that doesn't agree
    with its header raises.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, local = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with files.open_input_file(local) as file:
                    for head, body in records(file):
                        claimed = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind, n = head["warc-type"], len(body)
                        if kind == "revisit":
                            n = int(head["x-payload-length"])
                        elif hashlib.sha1(body).hexdigest() != claimed:
                            raise ValueError(f"{path}: payload of {head['warc-record-id']} is damaged")
                        row = (_id(head["warc-record-id"]), kind, head.get("warc-target-uri"), _id(head.get("warc-refers-to")), claimed, n)
                        rows.append((*row, body) if payload else row)
                        held += len(body) if payload else 0
                        if len(rows) >= 5000 or held >= READ:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return manifest.select("path").mapInArrow(run, RECORDS + ", payload binary" * payload)


# Writing -----------------------------------------------------------------------------------------


def record(id_, uri: str | None, refers_to, payload: bytes) -> bytes:
    """One gzipped record; a revisit if it refers to another."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_RECORD.format('null' if id_ is None else id_)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri))
    if refers_to is None:
        body += payload
    else:
        head += [
            f"WARC-Refers-To: {_RECORD.format(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Payload-Length: {len(payload)}",
        ]
    head.append(f"Content-Length: {len(body)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


class Package:
    """A ZIP package that grows record by record."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.index = 0, io.BytesIO()

    def add(self, id_, uri, refers_to, payload: bytes) -> None:
        raw = record(id_, uri, refers_to, payload)
        where = {"url": uri or "", "filename": ARCHIVE, "offset": str(self.at), "length": str(len(raw))}
        self.index.write(f"{_RECORD.format(id_)} 20000101000000 {json.dumps(where)}\n".encode())
        self.data.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
        self.zip.close()


def write_packages(pages: DataFrame, *, id_: str = "page_id", uri: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """Write packages into the shared folder; the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_).alias("id"), F.col(uri).alias("uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    repeated = cut(repeated.where("n > 1").select("digest", "last"))
    rows = rows.join(small(repeated), "digest", "left")
    refers = F.when(F.col("last").isNotNull() & null_first_less(F.col("id"), F.col("last")), F.col("last"))
    rows = rows.select("id", "uri", refers.alias("refers_to"), "payload")
    folder = shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, local = fs.FileSystem.from_uri(folder)
        files.create_dir(local, recursive=True)
        package = None

        def done():
            package.close()
            sink.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([package.at], pa.int64())], names=["path", "records", "bytes"]
            )

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                for i, u, r, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), as_text(part.column(3))):
                    if package is None:
                        name, n = f"{uuid.uuid4().hex}.wacz", 0
                        sink = files.open_output_stream(f"{local}/{name}")
                        package = Package(sink)
                    package.add(i, u, r, p.encode())
                    n += 1
                    if package.at >= PACKAGE:
                        yield done()
                        package = None
        if package is not None:
            yield done()

    return cut(rows.mapInArrow(run, "path string, records long, bytes long"))


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write the pages and read them back; the packages are dealt out over tasks."""
    manifest = write_packages(pages, **options)
    tasks = max(1, min(manifest.count(), 10_000))
    return read_packages(manifest.repartition(tasks))
