"""WARC in ZIP packages: a writer, and a reader that range-reads stored members without extraction.

An archive is a ZIP (ZIP64 where an offset, size or count asks for it) with two stored members: `archive/data.warc.gz`,
one gzip member per WARC record, and `indexes/index.cdxj`, one JSON line per record with its place in that member. The
reader seeks to the end of central directory, follows the ZIP64 locator, parses the central directory, finds where the
stored data begins, and reads the ranges of records that it wants.

Cases: a null payload is written as an empty one; a null id sorts below every other one and is kept as null; repeated
rows are records of their own; an empty table gives no archive and an empty result; columns besides the id and the
payload aren't read. Payloads of any length are whole records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import looked_up, materialize, new_path

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
EMPTY_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()

# Fixed values of the ZIP format: signatures, and the mark of a value that ZIP64 holds.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


class Package:
    """Writes a ZIP of stored members. zip64: always write ZIP64 fields, as large archives need."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.zip64, self.at, self.members = sink, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> int:
        """Add a member and return where its data begins."""
        crc, size = 0, sum(map(len, chunks))
        for c in chunks:
            crc = zlib.crc32(c, crc)
        large, start, raw = self.zip64 or size >= FULL32, self.at, name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        shown = FULL32 if large else size
        self._write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if large else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        begin = self.at
        for c in chunks:
            self._write(c)
        self.members.append((raw, crc, size, start))
        return begin

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, start in self.members:
            large = self.zip64 or size >= FULL32 or start >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if large else b""
            shown, place = (FULL32, FULL32) if large else (size, start)
            self._write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if large else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        end, n = self.at, len(self.members)
        if self.zip64 or begin >= FULL32 or end - begin >= FULL32 or n >= FULL16:
            self._write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, end - begin, begin))
            self._write(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
            self._write(END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        else:
            self._write(END + struct.pack("<HHHHIIH", 0, 0, n, n, end - begin, begin, 0))


class Reader:
    """Members of a ZIP, by name: (method, size stored, start of the data). file: seekable, opened for reading."""

    def __init__(self, file):
        self.file = file
        total = file.seek(0, io.SEEK_END)
        tail = self._read(max(0, total - 65_557 - 20), total)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end of central directory")
        n, size, begin = struct.unpack("<10xHII", tail[at : at + 20])
        if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
            (place,) = struct.unpack("<8xQ", tail[at - 20 : at - 4])
            head = self._read(place, place + 56)
            if head[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            n, size, begin = struct.unpack("<32xQQQ", head)
        self.members = dict(self._members(self._read(begin, begin + size), n))

    def _read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(stop - start)

    @staticmethod
    def _members(directory: bytes, n: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(n):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, stored, size, name, extra, comment, place = struct.unpack("<10xH8xIIHHH8xI", directory[at : at + 46])
            raw, more = directory[at + 46 : at + 46 + name], directory[at + 46 + name : at + 46 + name + extra]
            while len(more) >= 4:
                kind, length = struct.unpack("<HH", more[:4])
                if kind == 1:
                    values = iter(struct.unpack(f"<{length // 8}Q", more[4 : 4 + length // 8 * 8]))
                    if size == FULL32:
                        size = next(values)
                    if stored == FULL32:
                        stored = next(values)
                    if place == FULL32:
                        place = next(values)
                more = more[4 + length :]
            at += 46 + name + extra + comment
            yield raw.decode(), (method, stored, place)

    def locate(self, name: str) -> tuple[int, int]:
        """Where the data of a stored member begins, and its size."""
        method, size, place = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored but compressed by method {method}")
        head = self._read(place, place + 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        name_size, extra = struct.unpack("<26xHH", head)
        return place + 30 + name_size + extra, size

    def range(self, name: str, start: int, stop: int) -> bytes:
        begin, size = self.locate(name)
        return self._read(begin + start, begin + min(stop, size))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(id_: int | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with its payload, or a revisit record with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if id_ is None else id_}>", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if revisit else http + payload
    return "\r\n".join([*lines, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The headers of a WARC record (lower-cased names), its HTTP headers and its payload."""

    def split(block: bytes) -> tuple[dict[str, str], bytes]:
        head, _, rest = block.partition(b"\r\n\r\n")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}, rest

    headers, rest = split(data)
    http, payload = split(rest[: int(headers["content-length"])])
    return {"headers": headers, "http": http, "payload": payload}


def _opened(path: str, mode: str):
    """A file of the shared folder: by its local name, or through pyarrow's file systems for another scheme."""
    if path.startswith(("file:", "/")):
        import os

        local = "/" + path.removeprefix("file:").lstrip("/")
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    if mode == "wb":
        system.create_dir(place.rpartition("/")[0], recursive=True)
        return system.open_output_stream(place)
    return system.open_input_file(place)


def _archive(folder: str, records: list[tuple[int | None, bytes]], zip64: bool) -> tuple[str, int]:
    """Write an archive under a name of its own; a task that is run again writes another one."""
    path, index, at = f"{folder}/{uuid.uuid4().hex}.wacz", [], 0
    for id_, data in records:
        index.append(json.dumps({"id": id_, "offset": at, "length": len(data)}).encode() + b"\n")
        at += len(data)
    with _opened(path, "wb") as sink:
        package = Package(sink, zip64)
        package.add(DATA, [data for _, data in records])
        package.add(INDEX, index)
        package.close()
    return path, len(records)


def digest_column(payload: Column) -> Column:
    return F.sha1(F.coalesce(payload, F.lit("")).cast("binary"))


def write(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write a record per row and return the archives: path string, records long.

    Of rows with equal payloads of at least least_bytes bytes, those with the largest id are responses and the others
    revisits of it. Digests and ids are stored once; the largest id of a digest is looked up by them alone, and of a digest that many rows have by
    rows dealt out by id; payloads move by both, so one that a third of all rows share goes to all tasks.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(payload_column), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    keys = materialize(rows.where(F.length("payload") >= least_bytes).select("sha1", "id").distinct(), "keys")
    tops = looked_up(keys, "sha1", "id", F.max("id"), "top").toDF("top_sha1", "top_id", "top")
    paired = rows.join(tops.hint("shuffle_hash"), (F.col("sha1") == F.col("top_sha1")) & F.col("id").eqNullSafe(F.col("top_id")), "left").select("id", "payload", "sha1", "top")
    folder = new_path(pages.sparkSession, "warc")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> pa.RecordBatch:
            path, n = _archive(folder, held, zip64)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for id_, payload, sha1, top in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = top is not None and id_ != top
                packed = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record(id_, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), top, revisit)
                held.append((id_, packed.compress(data) + packed.flush()))
                size += len(held[-1][1])
                if size >= archive_bytes:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    return materialize(paired.mapInArrow(archives, "path string, records long"), "archives")


def read(archives: DataFrame, run_bytes: int = 1 << 20) -> DataFrame:
    """The records of archives: id, type, digest (bare base32), payload_bytes, refers_to, payload (null for revisits).

    The index is read first; records then come by range, as many neighbours at once as run_bytes holds.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                with _opened(path, "rb") as file:
                    reader = Reader(file)
                    index = [json.loads(x) for x in reader.range(INDEX, 0, reader.locate(INDEX)[1]).splitlines()]
                    i = 0
                    while i < len(index):
                        j, start = i + 1, index[i]["offset"]
                        while j < len(index) and index[j]["offset"] + index[j]["length"] - start <= run_bytes:
                            j += 1
                        data = reader.range(DATA, start, index[j - 1]["offset"] + index[j - 1]["length"])
                        yield _columns([(x["id"], parse(zlib.decompress(data[x["offset"] - start : x["offset"] - start + x["length"]], 31))) for x in index[i:j]])
                        i = j

    return archives.select("path").mapInArrow(records, "id long, type string, digest string, payload_bytes long, refers_to long, payload binary")


def _columns(found: list[tuple[int | None, dict]]) -> pa.RecordBatch:
    out: dict[str, list] = {k: [] for k in ("id", "type", "digest", "payload_bytes", "refers_to", "payload")}
    for id_, x in found:
        headers, payload = x["headers"], x["payload"]
        revisit = headers["warc-type"] == "revisit"
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and base32_sha1(payload) != digest:
            raise ValueError(f"record {id_}: the payload's digest isn't {digest}")
        out["id"].append(id_)
        out["type"].append(headers["warc-type"])
        out["digest"].append(digest)
        out["payload_bytes"].append(int(x["http"]["content-length"]))
        out["refers_to"].append(int(headers["warc-refers-to"][len("<urn:page:") : -1]) if revisit else None)
        out["payload"].append(None if revisit else payload)
    kinds = [("id", pa.int64()), ("type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    return pa.RecordBatch.from_pydict(out, pa.schema(kinds))
