"""WARC records in ZIP packages: written in parallel, read back by ranges.

A package is a ZIP file with stored (uncompressed) members: archive/data-N.warc.gz, whose records are gzip members of
their own, and indexes/index-N.cdx, with a line for each record: its place in the archive member. The reader takes the
end-of-directory record from the file's tail, follows ZIP64 records where there are any, parses the central directory,
locates archive and index members, and reads each record by its range. Nothing is unpacked, and no file is read whole.

Files are opened through pyarrow's file systems, so any store that executors share will do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, broadcast_if_small, cut, shared_dir, with_row_id

LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
#: Bytes of an archive member at which the next one begins.
MEMBER_BYTES = 8 << 20
#: Bytes of an archive that one task reads, about.
RANGE_BYTES = 16 << 20
RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- ZIP packages


class ZipWriter:
    """Writes stored members one after another to a stream that can't seek."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, size, begin = name.encode(), zlib.crc32(data), len(data), self.at
        wide = self.zip64 or size >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = FULL32 if wide else size
        self._write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra)
        self._write(data)
        self.entries.append((raw, crc, size, begin))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, at in self.entries:
            wide = self.zip64 or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            short, place = (FULL32, FULL32) if wide else (size, at)
            self._write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        n, size = len(self.entries), self.at - begin
        if wide := self.zip64 or n >= FULL16 or begin >= FULL32 or size >= FULL32:
            end64 = self.at
            self._write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin))
            self._write(LOCATOR + struct.pack("<IQI", 0, end64, 1))
        counted, length, place = (FULL16, FULL32, FULL32) if wide else (n, size, begin)
        self._write(END + struct.pack("<HHHHIIH", 0, 0, counted, counted, length, place, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    size: int
    stored: int
    header: int


def read_range(file, begin: int, length: int) -> bytes:
    file.seek(begin)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"the file ends at {begin + len(data)}, {begin + length} was asked for")
    return data


def directory(file, size: int) -> list[Member]:
    """The members that the central directory of an opened ZIP file names."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read_range(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature may stand in the comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    _, _, _, count, length, begin, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if FULL16 == count or FULL32 in (length, begin):
        locator = read_range(file, tail_at + at - 20, 20)
        if locator[:4] == LOCATOR:
            end64 = read_range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("the ZIP64 end record isn't where its locator says")
            count, length, begin = struct.unpack_from("<QQQ", end64, 32)
    data, at, members = read_range(file, begin, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method, _, _, crc, stored, full, name_n, extra_n, note_n, _, _, _, header = struct.unpack_from("<HHHHIIIHHHHHII", data, at + 8)
        name = data[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        wide = {"full": full == FULL32, "stored": stored == FULL32, "header": header == FULL32}
        extra, x = data[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while any(wide.values()) and x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                full, stored, header = (next(values) if wide[k] else v for k, v in (("full", full), ("stored", stored), ("header", header)))
                break
            x += 4 + n
        members.append(Member(name, method, crc, full, stored, header))
        at += 46 + name_n + extra_n + note_n
    return members


def data_begin(file, member: Member) -> int:
    """Where a member's bytes begin: after its local header, whose lengths are its own."""
    head = read_range(file, member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name}: no local header at {member.header}")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name_n + extra_n


# ---- WARC records


def record_id(page_id: int | None, row_id: int) -> str:
    return f"<urn:page:{'null-' + str(row_id) if page_id is None else page_id}>"


def warc_record(row: dict) -> bytes:
    """One record; a revisit has no payload of its own and names the record that has it."""
    payload, revisit = row["payload"], row["revisit"]
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["page_id"], row["row_id"])),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"] or "")),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("Content-Type", "application/octet-stream"),
        ("Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(row["refers_to"], row["refers_row"]))]
    body = b"" if revisit else payload
    headers.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines if ": " in line)}
    body = rest[: int(fields["content-length"])]
    number = lambda urn: int(last) if (last := urn.strip("<>").removeprefix("urn:page:")).removeprefix("-").isdecimal() else None
    revisit, stated = fields["warc-type"] == "revisit", fields.get("warc-payload-digest", f"sha1:{digest(body)}").removeprefix("sha1:")
    if not revisit and digest(body) != stated:
        raise ValueError(f"{fields['warc-record-id']}: the payload doesn't match its digest")
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri", ""),
        "record_type": fields["warc-type"],
        "payload": None if revisit else body,
        "payload_bytes": int(fields.get("payload-length", 0)) if revisit else len(body),
        "payload_digest": stated,
        "refers_to": number(fields.get("warc-refers-to", "")) if revisit else None,
    }


# ---- Spark jobs


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")


def write_package(out, rows: Iterable[dict], zip64: bool) -> int:
    """Writes records to a package, one archive member's worth in memory; gives their number."""
    package, member, lines, total, at, nth = ZipWriter(out, zip64), [], [], 0, 0, 0

    def flush() -> None:
        nonlocal member, lines, at, nth
        package.add(f"archive/data-{nth:05d}.warc.gz", b"".join(member))
        package.add(f"indexes/index-{nth:05d}.cdx", "".join(lines).encode())
        member, lines, at, nth = [], [], 0, nth + 1

    for row in rows:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(warc_record(row)) + packer.flush()
        lines.append(json.dumps({"filename": f"archive/data-{nth:05d}.warc.gz", "offset": at, "length": len(data), "digest": row["digest"]}) + "\n")
        member.append(data)
        at, total = at + len(data), total + 1
        if at >= MEMBER_BYTES:
            flush()
    if member:
        flush()
    package.close()
    return total


def repeated_payloads(keyed: DataFrame) -> DataFrame:
    """(row_id, refers_to, refers_row) of rows (row_id, page_id, sha1) whose digest an earlier one has: the row to which
    each refers. Rows in order of page_id, null last, then of row_id; null digests aren't compared. Payloads take no part."""
    own = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row_id")
    ids = cut(keyed.where("sha1 is not null").select("row_id", "page_id", F.unhex("sha1").alias("sha1")))
    first = ids.groupBy("sha1").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    found = ids.select("row_id", "sha1").join(broadcast_if_small(first), "sha1").where(F.col("row_id") != F.col("first.row_id"))
    return found.select("row_id", F.col("first.page_id").alias("refers_to"), F.col("first.row_id").alias("refers_row"))


def write_archives(pages: DataFrame, root: str, least: int = 0, zip64: bool = True) -> DataFrame:
    """Writes each row of pages (page_id, url, html, ...) as a record to packages under root, one for each task; gives
    (path, records). Of equal payloads of `least` bytes or more, that with the smallest page_id is the response. Only
    digests and row numbers are compared between tasks; payloads stay where they are read, unless there are more
    revisits than broadcast_if_small takes.

    A task writes under a name of its own attempt and renames it when done, so one that runs again replaces its package.
    """
    named = with_row_id(pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")), "row_id")
    keyed = named.select("row_id", "page_id", F.when(F.octet_length("payload") >= least, F.sha1("payload")).alias("sha1"))
    marks = broadcast_if_small(repeated_payloads(keyed), SMALL_IDS)
    rows = named.join(marks, "row_id", "left").select("page_id", "url", "payload", "row_id", F.col("refers_row").isNotNull().alias("revisit"), "refers_to", "refers_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = opened(root)
        name = f"{base}/part-{task.partitionId():05d}.wacz"
        aside = f"{name}.{task.taskAttemptId()}.tmp"

        def records() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield {**r, "digest": digest(r["payload"])}

        files.create_dir(base)
        with files.open_output_stream(aside) as out:
            n = write_package(out, records(), zip64)
        files.move(aside, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return rows.mapInArrow(run, "path string, records long")


def member_bytes(file, member: Member) -> bytes:
    """A whole member, unpacked if need be and held against its checksum: for indexes, which are small."""
    data = read_range(file, data_begin(file, member), member.stored)
    if member.method == 8:
        data = zlib.decompress(data, -15)
    elif member.method:
        raise ValueError(f"{member.name}: compression method {member.method} isn't known")
    if zlib.crc32(data) != member.crc:
        raise ValueError(f"{member.name} is damaged")
    return data


def index_entries(listed: bytes) -> list[dict]:
    """The JSON objects of an index: a line is one, or has a key and a time before it."""
    lines = (line.strip() for line in listed.decode().splitlines())
    return [json.loads(line[line.index("{") :]) for line in lines if "{" in line]


def walked(file, begin: int, size: int, piece: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members in a stored archive member, found by unpacking it piece by piece: for
    archives that no index names."""
    at, start, unpacker, data = 0, 0, zlib.decompressobj(31), b""
    while at < size or data:
        if not data:
            data = read_range(file, begin + at, min(piece, size - at))
            at += len(data)
        unpacker.decompress(data)
        if unpacker.eof:
            data = unpacker.unused_data
            end = at - len(data)
            yield start, end - start
            start, unpacker = end, zlib.decompressobj(31)
        else:
            data = b""
    if start < size:
        raise ValueError(f"an archive ends within the record at {start}")


def index_batches(root: str):
    """Packages (path) to the ranges of their records (path, begin, length): from the index members, and for archives
    that no index names from the archive itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(root)
        schema = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("length", pa.int64())])

        def ranges(path: str, begin: int, found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [path] * len(found), "begin": [begin + o for o, _ in found], "length": [n for _, n in found]}, schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_file(path) as file:
                    members = {m.name: m for m in directory(file, file.size())}
                    begins: dict[str, int] = {}
                    for m in members.values():
                        if not m.name.startswith("indexes/") or m.name.endswith("/"):
                            continue
                        found: dict[str, list[tuple[int, int]]] = {}
                        for e in index_entries(member_bytes(file, m)):
                            name = e["filename"] if e["filename"] in members else f"archive/{e['filename']}"
                            found.setdefault(name, []).append((int(e["offset"]), int(e["length"])))
                        for name, places in found.items():
                            if name not in begins:
                                if members[name].method:
                                    raise ValueError(f"{path}: {name} isn't stored, it has no ranges")
                                begins[name] = data_begin(file, members[name])
                            yield ranges(path, begins[name], places)
                    for m in members.values():
                        if m.name.startswith("archive/") and m.name.endswith(".gz") and m.name not in begins:
                            if m.method:
                                raise ValueError(f"{path}: {m.name} isn't stored, it has no ranges")
                            begin = data_begin(file, m)
                            yield ranges(path, begin, list(walked(file, begin, m.size)))

    return run


def record_batches(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        path, file = None, None
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                if (now := batch.column(0)[at].as_py()) != path:
                    path, file = now, files.open_input_file(now)
                data = read_range(file, batch.column(1)[at].as_py(), batch.column(2)[at].as_py())
                rows.append(parse_record(zlib.decompress(data, 31)))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(packages: DataFrame, root: str) -> DataFrame:
    """The records (RECORDS) of packages (path, ...): the index members are read by package, then ranges of records by
    stretches of about RANGE_BYTES, so one large package is read by many tasks."""
    ranges = packages.select("path").mapInArrow(index_batches(root), "path string, begin long, length long")
    stretch = F.floor(F.col("begin") / RANGE_BYTES).alias("stretch")
    dealt = ranges.select("path", "begin", "length", stretch).repartition("path", "stretch").sortWithinPartitions("path", "begin")
    return dealt.select("path", "begin", "length").mapInArrow(record_batches(root), RECORDS)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: one row (RECORDS) for each row of pages.

    A null html has an empty payload; null page ids come back null and are responses only where no other row has the
    payload; of repeated rows the first is the response; an empty table gives no rows; other columns are not looked at.
    A very long page is one record, held whole by the task that writes or reads it.
    """
    root = f"{shared_dir(pages.sparkSession).rstrip('/')}/archives-{uuid.uuid4().hex}"
    return read_archives(cut(write_archives(pages, root, least)), root)
