"""Web archive records inside ZIP packages, written and range-read by Spark tasks.

A package is a ZIP file whose members are stored, not compressed: `archive/data.warc` with one WARC
record per page and `indexes/index.cdxj` with a JSON line per record (its offset and length inside
the archive member). `read_packages` parses the end record, the ZIP64 records and the central
directory, finds the members, reads the index, and then reads each record by its byte range.

Writing: pages with equal payloads share one response record, of the smallest page_id; the others
are revisit records that refer to it and carry no payload. Packages are written as streams, so a
task holds one page at a time; a package is cut when it reaches `package_bytes`. Names are unique
per attempt and only packages that the written manifest lists count, so lost or repeated tasks
leave at most unread files. Files go through pyarrow's file systems by URI (local or shared mounts,
HDFS, object stores), never to a machine-local folder on a cluster.

Defined results: a null payload is empty; an empty payload is shared like any other from
`least_bytes` = 0 on; rows with a null page_id get records without an id and never serve as
response for others; rows that repeat a page_id give a record each, of which the ones that share
the smallest id and payload are all responses; an empty table gives no package and no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm.common import broadcast_if_small, work_folder, written

ARCHIVE, INDEX = "archive/data.warc", "indexes/index.cdxj"
# Fixed values of the ZIP format: signatures of its records, and the number that says "see ZIP64".
END, END64_LOCATOR, END64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
IN_ZIP64 = 0xFFFFFFFF

# Bytes of records that one task reads, about.
TASK_BYTES = 8 << 20


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ----------------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC 1.1 record. A revisit states the full payload's digest and length in its headers."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if refers_to is not None else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("a WARC record is cut off")
    return headers, rest[:length]


# --- packages ---------------------------------------------------------------------------------


class PackageWriter:
    """Streams records into the archive member; the index follows when the package is closed."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self._out = system.open_output_stream(path)
        self._zip = zipfile.ZipFile(_Unseekable(self._out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self._member = self._zip.open(ARCHIVE, "w", force_zip64=True)
        self._index = io.StringIO()
        self.bytes = self.records = 0

    def add(self, page_id, url: str | None, payload: bytes, refers_to) -> None:
        data = record(page_id, url, payload, refers_to)
        self._member.write(data)
        self._index.write(json.dumps({"id": page_id, "offset": self.bytes, "length": len(data)}) + "\n")
        self.bytes += len(data)
        self.records += 1

    def close(self) -> None:
        self._member.close()
        with self._zip.open(INDEX, "w", force_zip64=True) as member:
            member.write(self._index.getvalue().encode())
        self._zip.close()
        self._out.close()


class _Unseekable(io.RawIOBase):
    """Append-only view of an output stream, which object stores need."""

    def __init__(self, out):
        self._out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


class PackageReader:
    """Members of a ZIP file by name: place and size of their stored bytes. Reads ranges only."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self._file = system.open_input_file(path)
        self.members = self._directory()

    def close(self) -> None:
        self._file.close()

    def range(self, start: int, length: int) -> bytes:
        data = self._file.read_at(length, start)
        if len(data) != length:
            raise ValueError("the package is cut off")
        return data

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name: local header's place, stored size, method."""
        size = self._file.size()
        tail_at = max(0, size - 65_557)  # the end record and the longest comment
        tail = self.range(tail_at, size - tail_at)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("not a ZIP file")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if count == 0xFFFF or IN_ZIP64 in (length, start):
            locator = self.range(tail_at + at - 20, 20)
            if locator[:4] != END64_LOCATOR:
                raise ValueError("the ZIP64 locator is missing")
            end = self.range(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != END64:
                raise ValueError("the ZIP64 end record is missing")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        data, members, at = self.range(start, length), {}, 0
        for _ in range(count):
            if data[at : at + 4] != ENTRY:
                raise ValueError("the central directory is damaged")
            method, stored, full = struct.unpack("<H8xII", data[at + 10 : at + 28])
            name_size, extra_size, comment_size = struct.unpack("<HHH", data[at + 28 : at + 34])
            place = struct.unpack("<I", data[at + 42 : at + 46])[0]
            name = data[at + 46 : at + 46 + name_size].decode("utf-8")
            extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
            stored, place = self._zip64(extra, full, stored, place)
            members[name] = (place, stored, method)
            at += 46 + name_size + extra_size + comment_size
        return members

    @staticmethod
    def _zip64(extra: bytes, full: int, stored: int, place: int) -> tuple[int, int]:
        """The 64-bit field holds, in this order, only those numbers that did not fit."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack("<HH", extra[at : at + 4])
            if kind == 1:
                numbers = iter(struct.unpack(f"<{size // 8}Q", extra[at + 4 : at + 4 + size // 8 * 8]))
                if full == IN_ZIP64:
                    next(numbers)
                return next(numbers) if stored == IN_ZIP64 else stored, next(numbers) if place == IN_ZIP64 else place
            at += 4 + size
        return stored, place

    def stored(self, name: str) -> tuple[int, int]:
        """First byte and size of a stored member's data. The local header's own lengths count."""
        place, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.range(place, 30)
        if head[:4] != LOCAL:
            raise ValueError("a local header is damaged")
        name_size, extra_size = struct.unpack("<HH", head[26:30])
        return place + 30 + name_size + extra_size, size


# --- Spark jobs -------------------------------------------------------------------------------


def with_refers_to(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id of equal payloads, null on that page itself.

    Only digests are grouped, with partial minima, so a payload that a third of the pages share is
    no hot group; and only pages that do refer to another one are joined back.
    """
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = base.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("bytes")).where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
    first = keyed.groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where(F.col("first") < F.col("last"))
    repeats = keyed.join(first, ["sha", "bytes"]).where(F.col("page_id") > F.col("first"))
    repeats = repeats.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")).distinct()
    repeats = written(repeats, "warc-repeats")
    # Where revisits are few, the pages themselves are not shuffled.
    repeats = broadcast_if_small(repeats, repeats.count(), 80)
    same = (F.col("page_id") == F.col("_id")) & (F.sha1(F.col("html").cast("binary")) == F.col("_sha"))
    return base.join(repeats, same, "left").select("page_id", "url", "html", "refers_to")


def write_packages(pages: DataFrame, folder: str, package_bytes: int = 1 << 30, least_bytes: int = 0) -> DataFrame:
    """Writes the packages and their manifest (package, records, bytes), and returns the manifest as stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, done = None, "", []
        for batch in batches:
            ids, urls, refers = batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist()
            for i, page_id in enumerate(ids):
                if writer is None:
                    name = f"{folder}/{uuid.uuid4().hex}.wacz"
                    writer = PackageWriter(name)
                writer.add(page_id, urls[i].as_py(), batch.column(2)[i].as_py().encode("utf-8", "surrogatepass"), refers[i])
                if writer.bytes >= package_bytes:
                    writer.close()
                    done.append((name, writer.records, writer.bytes))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((name, writer.records, writer.bytes))
        kinds = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)], names=["package", "records", "bytes"])

    return written(with_refers_to(pages, least_bytes).mapInArrow(run, "package string, records bigint, bytes bigint"), "warc-manifest")


def locate_records(manifest: DataFrame) -> DataFrame:
    """package, start, length of every record, from the packages' directories and indexes alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                reader = PackageReader(package)
                start, _ = reader.stored(ARCHIVE)
                lines = io.BytesIO(reader.range(*reader.stored(INDEX)))
                while part := lines.readlines(4 << 20):
                    found = [json.loads(line) for line in part]
                    out = [pa.array([package] * len(found)), pa.array([start + f["offset"] for f in found], pa.int64()), pa.array([f["length"] for f in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, names=["package", "start", "length"])
                reader.close()

    # A package a task: the manifest's rows are few, and would otherwise all be joined into one.
    return manifest.select("package").repartition(max(1, manifest.count()), "package").mapInArrow(run, "package string, start bigint, length bigint")


def read_packages(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Record places are dealt out by package and range, so one large package is read by many tasks,
    each of them in file order. A response whose bytes do not match its digest raises.
    """
    places = locate_records(manifest).withColumn("block", (F.col("start") / TASK_BYTES).cast("long"))
    # As many tasks as there are bytes to read, whatever the size of the rows that say where they are.
    tasks = 1 + (manifest.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES
    dealt = places.repartition(tasks, "package", "block").sortWithinPartitions("package", "start").drop("block")
    kind = pa.int64() if id_type == "bigint" else pa.string()
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def page(value: str | None):
        text = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return None if not text else int(text) if pa.types.is_integer(kind) else text

    def parsed(data: bytes) -> tuple:
        headers, body = parse_record(data)
        stated = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "response" and digest(body) != stated:
            raise ValueError(f"the payload of {headers['warc-record-id']} does not match its digest")
        revisit = headers["warc-type"] == "revisit"
        return page(headers["warc-record-id"]), headers["warc-target-uri"], None if revisit else body, int(headers["x-payload-length"]), stated, headers["warc-type"], page(headers.get("warc-refers-to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, package = None, None
        kinds = [kind, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), kind]
        for batch in batches:
            rows, size = [], 0
            for name, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != package:
                    if reader is not None:
                        reader.close()
                    reader, package = PackageReader(name), name
                rows.append(parsed(reader.range(start, length)))
                size += length
                if size >= 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if reader is not None:
            reader.close()

    return dealt.mapInArrow(run, f"page_id {id_type}, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}")


def package_folder(spark: SparkSession) -> str:
    return work_folder(spark, "warc")
