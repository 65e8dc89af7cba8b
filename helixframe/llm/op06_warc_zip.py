"""Operator 6: WARC records in ZIP packages, read back by ranges.

A package is a ZIP file with stored (uncompressed) members: archive/data.warc.gz, one gzip member per record, and
indexes/index.cdxj, one line per record with its offset and length inside the archive member. The reader parses the end
record, the ZIP64 locator and end record, and the central directory itself, finds where a stored member's bytes start
from its local header, and reads the index and single records by byte range; nothing is extracted.

Records with equal payloads of at least min_bytes bytes are written once: that of the smallest key is a response, the
others are revisits that refer to it. Which payloads repeat is found by a count per SHA-256 digest with partial
aggregation, and joined to the rows' digests alone; payloads travel once, to the partition that writes them.

Defined results: a null payload counts as empty; payloads shorter than min_bytes are always responses; rows that repeat a
response's key and payload are responses too; a null key is written as an empty page id and comes back null, its
record never one to refer to unless all its equals have null keys; payloads are streamed record by record; an empty
table gives no packages; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, work_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the formats.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"


# ---- ZIP, by ranges ----------------------------------------------------------------------------------------------


class RangeZip:
    """Directory of a ZIP file and range reads inside its stored members."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail_at = max(0, size - 65_557)
        tail = self._read(tail_at, size - tail_at)
        # An end mark inside the archive comment is no end record: the comment of a true one reaches the file's end, and
        # its directory is where it says. A comment may even hold the record of an empty archive, so one with members wins.
        ends, problem = [], "no end record: not a ZIP file, or a damaged one"
        at = tail.rfind(END)
        while at >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                try:
                    ends.append(self._directory(tail_at + at, tail[at : at + 22], size))
                except ValueError as e:
                    problem = str(e)
            at = tail.rfind(END, 0, at)
        if not ends:
            raise ValueError(problem)
        self.members = next((m for m in ends if m), {})  # name -> method, size, local header
        self._starts: dict[str, int] = {}

    def _directory(self, end: int, record: bytes, size: int) -> dict[str, tuple[int, int, int]]:
        """The members by the end record at place `end`."""
        count, length, start = struct.unpack_from("<H", record, 10)[0], *struct.unpack_from("<II", record, 12)
        locator = self._read(end - 20, 20) if end >= 20 else b""
        if locator[:4] == LOCATOR64:
            # bytes before the archive move the record; it then stands right before its locator
            for place in (struct.unpack_from("<Q", locator, 8)[0], end - 76):
                end64 = self._read(place, 56) if 0 <= place <= size - 56 else b""
                if end64[:4] == END64:
                    break
            else:
                raise ValueError("the ZIP64 end record is missing")
            count, length, start = struct.unpack_from("<Q", end64, 32)[0], *struct.unpack_from("<QQ", end64, 40)
            end = place
        before = end - length - start  # bytes before the archive, which its offsets don't count
        if before < 0:
            raise ValueError("the central directory is damaged")
        members: dict[str, tuple[int, int, int]] = {}
        raw, at = self._read(start + before, length), 0
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL or at + 46 > len(raw):
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, at = raw[at + 46 + n_name : at + 46 + n_name + n_extra], at + 46 + n_name + n_extra + n_comment
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            members[name] = method, packed, header + before
        if raw[at : at + 4] == CENTRAL:
            raise ValueError("the central directory has more entries than its end record counts")
        return members

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        """n bytes of a stored member from place at."""
        method, size, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed: only stored members can be read by range")
        if name not in self._starts:
            head = self._read(header, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"{name}: no local header")
            self._starts[name] = header + 30 + sum(struct.unpack_from("<HH", head, 26))
        n = size - at if n is None else min(n, size - at)
        return self._read(self._starts[name] + at, n)


# ---- WARC --------------------------------------------------------------------------------------------------------


def record_bytes(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit (refers_to given) carries no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix("urn:page:")
    return int(name) if name else None


class PackageWriter:
    """Streams records into the archive member of a package, then adds its index member."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[bytes] = []
        self.at = 0

    def add(self, page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> None:
        raw = record_bytes(page, url, payload, digest, refers_to)
        self.member.write(raw)
        self.index.append(json.dumps({"page": page, "offset": self.at, "length": len(raw)}).encode() + b"\n")
        self.at += len(raw)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), b"".join(self.index))
        self.zip.close()
        self.out.close()
        return len(self.index)


def records(uri: str, read_bytes: int = 8 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a package in index order, read by ranges of about read_bytes."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as file:
        package = RangeZip(file)
        places = [(x["offset"], x["length"]) for x in map(json.loads, package.read(INDEX).splitlines())]
        i = 0
        while i < len(places):
            j = i + 1
            while j < len(places) and places[j][0] + places[j][1] - places[i][0] <= read_bytes:
                j += 1
            raw = package.read(DATA, places[i][0], places[j - 1][0] + places[j - 1][1] - places[i][0])
            for at, n in places[i:j]:
                yield parse_record(raw[at - places[i][0] : at - places[i][0] + n])
            i = j


def read_record(uri: str, page: int) -> tuple[dict[str, str], bytes] | None:
    """The (first) record of one page: the index is read, then the record's own bytes alone."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as file:
        package = RangeZip(file)
        for x in map(json.loads, package.read(INDEX).splitlines()):
            if x["page"] == str(page):
                return parse_record(package.read(DATA, x["offset"], x["length"]))
    return None


# ---- Spark -------------------------------------------------------------------------------------------------------

MANIFEST = "shard int, part int, path string, n_records long"


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100, pages_per_task: int = 100_000, max_package_bytes: int = 1 << 30) -> DataFrame:
    """Writes packages below path, in ascending key order, and returns their manifest (one row per package).

    There is a task per pages_per_task pages (spark.sql.shuffle.partitions at least), and a task begins a new package
    when one holds max_package_bytes.
    """
    spark = pages.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pages.count() / pages_per_task))
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.encode(F.coalesce(payload, F.lit("")), "UTF-8").alias("p")).withColumn("d", F.sha2("p", 256))
    firsts = rows.where(F.octet_length("p") >= min_bytes).groupBy(F.col("d").alias("fd")).agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1")
    # The keys of revisits alone meet the digests; then both sides meet in the partition that writes them.
    revisits = rows.where(F.octet_length("p") >= min_bytes).select("k", "d").join(firsts, F.col("d") == F.col("fd")).where(~F.col("k").eqNullSafe(F.col("first"))).select("k", "d", F.col("first")).distinct()
    both = rows.select("k", "u", "p", "d", F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind")).unionByName(
        revisits.select("k", F.lit(None).cast("string").alias("u"), F.lit(None).cast("binary").alias("p"), "d", "first", F.lit(0).alias("kind"))
    )

    def row(shard: int, part: int, uri: str, n_records: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([uri]), pa.array([n_records], pa.int64())], ["shard", "part", "path", "n_records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, shard, part = None, "", TaskContext.get().partitionId(), 0
        noted: tuple | None = None
        for b in batches:
            for k, u, p, d, first, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    noted = k, d, first
                    continue
                if out is not None and out.at >= max_package_bytes:
                    yield row(shard, part, uri, out.close())
                    out, part = None, part + 1
                if out is None:
                    uri = f"{path}/pages-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.wacz"
                    out = PackageWriter(uri)
                refers = str(noted[2]) if noted is not None and noted[:2] == (k, d) and noted[2] is not None else None
                out.add("" if k is None else str(k), u, p, d, refers)
        if out is not None:
            yield row(shard, part, uri, out.close())

    ordered = both.repartitionByRange(n, "k").sortWithinPartitions("k", "d", "kind")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(manifest: DataFrame) -> DataFrame:
    """One row per record. A response's payload is digested again and must agree with its header."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                for h, payload in records(path):
                    size, digest, kind = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"]
                    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{path}: the payload of {h['warc-record-id']} is damaged")
                    rows.append((_page(h["warc-record-id"]), size, digest, kind, _page(h["warc-refers-to"]) if kind == "revisit" else None))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("path").repartition(max(1, n), "path").mapInArrow(run, READ)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    return read_back(write(pages, work_dir(pages.sparkSession, "warc")))
