"""Web archives in ZIP packages.

Writing packs gzip-compressed WARC records and their index as stored (uncompressed) members of
a ZIP file. Reading parses the central directory (ZIP64 too), finds the stored archive and
index members, and range-reads single records out of the package without extracting anything.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigraph.llm.shared import SMALL_ROWS, cut, new_path

#: The members that the writer makes. Readers take any names in these folders.
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: An index may have a list of its blocks beside it, so that a reader of some records needn't read all of it.
BLOCKS, INDEX_BLOCK = ".blocks", 2000
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


class ArchiveError(ValueError):
    """The bytes are not a package that this reader takes."""


# --- ZIP ---------------------------------------------------------------------------------------


class ZipWriter:
    """Writes stored members to a stream that can't seek: sizes follow the data in a descriptor."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.member = [name.encode(), self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x808, 0, 0, 0x21, 0, _MAX32, _MAX32, len(self.member[0]), len(extra)) + self.member[0] + extra)

    def data(self, part: bytes) -> None:
        self.member[2] = zlib.crc32(part, self.member[2])
        self.member[3] += len(part)
        self.write(part)

    def end(self) -> None:
        _, _, crc, size = self.member
        self.write(struct.pack("<4sIQQ", b"PK\7\x08", crc, size, size))
        self.members.append(self.member)

    def close(self) -> None:
        """The central directory with ZIP64 fields, and both end records."""
        start = self.at
        for name, offset, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x808, 0, 0, 0x21, crc, _MAX32, _MAX32, len(name), len(extra), 0, 0, 0, 0, _MAX32) + name + extra)
        size, count, end = self.at - start, len(self.members), self.at
        self.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, start))
        self.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int
    crc: int


def central_directory(file, length: int) -> list[Member]:
    """The members that the end records, ZIP64 or not, lead to. ``file`` has ``read_at(size, offset)``."""
    tail_at = max(0, length - 22 - _MAX16)
    tail = file.read_at(length - tail_at, tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) - at < 22 or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ArchiveError("no end record")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if _MAX16 == count or _MAX32 in (size, start):
        locator = file.read_at(20, tail_at + at - 20)
        if locator[:4] != b"PK\6\7":
            raise ArchiveError("no ZIP64 locator")
        record = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != b"PK\6\6":
            raise ArchiveError("no ZIP64 end record")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, members = file.read_at(size, start), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ArchiveError("a directory entry is broken")
        method, = struct.unpack_from("<H", directory, at + 10)
        crc, stored, full, names, extras, notes = struct.unpack_from("<IIIHHH", directory, at + 16)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode()
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:
                big = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(big) if full == _MAX32 else full
                stored = next(big) if stored == _MAX32 else stored
                header = next(big) if header == _MAX32 else header
            k += 4 + n
        members.append(Member(name, method, full, stored, header, crc))
        at += 46 + names + extras + notes
    return members


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method or member.size != member.stored:
        raise ArchiveError(f"{member.name} is compressed; records in it can't be range-read")
    head = file.read_at(30, member.header)
    if head[:4] != b"PK\3\4":
        raise ArchiveError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


# --- WARC --------------------------------------------------------------------------------------


def _header_value(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP head only, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_header_value(url)}"] if url else []
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, payload and declared size of one record; the payload's digest is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ArchiveError("not a WARC record")
    names = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(names["content-length"])]
    if len(block) != int(names["content-length"]):
        raise ArchiveError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)[1])
    digest = base64.b32decode(names["warc-payload-digest"].partition(":")[2]).hex()
    kind = names["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError(f"{names['warc-record-id']} differs from its digest")
    of = lambda name: (m := re.fullmatch(r"<urn:page:(-?\d+)>", names.get(name, ""))) and int(m[1])
    return {"page_id": of("warc-record-id"), "url": names.get("warc-target-uri"), "record_type": kind, "refers_to": of("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


# --- the operator ------------------------------------------------------------------------------


def plan_records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(digest, last_id, n) of the payloads of ``min_bytes`` or more that several rows have; the row with the largest id is stored."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    sizes = pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    return cut(sizes.groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payload_groups")


def write_packages(pages: DataFrame, path: str, min_bytes: int = 1000, max_bytes: int = 1 << 30, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Writes packages of about ``max_bytes`` below ``path``; returns the written list (package, records).

    A row refers to another by its own payload, so ids may repeat with different payloads. Pages are shuffled, by digest, only
    if more than ``small_rows`` payloads have copies; the most frequent of these still go by broadcast. ``path`` is a URI that the
    executors share. A task that is run again writes under a new name, and only the packages of tasks that succeeded are in the list.
    """
    groups = plan_records(pages, min_bytes)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"))
    if groups.count() <= small_rows:
        rows = rows.join(F.broadcast(groups), "digest", "left")
    else:
        top = F.broadcast(groups.orderBy(F.desc("n"), "digest").limit(1024))
        rest = rows.join(top.select("digest"), "digest", "left_anti").join(groups.hint("shuffle_hash"), "digest", "left")
        rows = rows.join(top, "digest").unionByName(rest)
    # a digest of a short payload is in no group
    rows = rows.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("last_id"), F.col("last_id")).alias("refers_to"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        zip_file, name, index, done = None, "", [], []

        def finish() -> None:
            zip_file.end()
            zip_file.begin(INDEX)
            blocks = []
            for first in range(0, len(index), INDEX_BLOCK):
                block = b"".join(index[first : first + INDEX_BLOCK])
                blocks.append({"first": first, "offset": zip_file.member[3], "length": len(block)})
                zip_file.data(block)
            zip_file.end()
            zip_file.begin(INDEX + BLOCKS)
            zip_file.data("".join(json.dumps(b) + "\n" for b in blocks).encode())
            zip_file.end()
            zip_file.close()
            zip_file.out.close()
            done.append((name, len(index)))

        for big in batches:
            for at in range(0, big.num_rows, 500):
                for row in big.slice(at, 500).to_pylist():
                    if zip_file is None:
                        name, index = f"{root}/{uuid4().hex}.wacz", []
                        zip_file = ZipWriter(store.open_output_stream(name))
                        zip_file.begin(ARCHIVE)
                    data = record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], date)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    packed = packer.compress(data) + packer.flush()
                    index.append(f"{_header_value(row['url'] or '-')} {json.dumps({'filename': ARCHIVE.rpartition('/')[2], 'offset': zip_file.member[3], 'length': len(packed)})}\n".encode())
                    zip_file.data(packed)
                    if zip_file.at >= max_bytes:
                        finish()
                        zip_file = None
        if zip_file is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["package", "records"])

    return cut(rows.mapInArrow(write, "package string, records long"), "packages")


def read_packages(packages: DataFrame, path: str, with_payload: bool = True, records_per_task: int = 20_000, read_bytes: int = 4 << 20) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` (and ``payload``) of all records.

    ``packages`` lists (package, records). Each task reads a run of up to ``records_per_task``
    records of one package, through the directory and the index, in ranges of ``read_bytes``.
    """
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.col("records") - 1, F.lit(0)), F.lit(records_per_task))).alias("first")
    runs = packages.where("records > 0").select("package", first)
    tasks = max(1, int(runs.count()))
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    kinds = dict(zip(["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"], ["long", "string", "string", "long", "long", "string", "binary"]))
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for run in batch.to_pylist():
                with store.open_input_file(run["package"]) as file:
                    for rows in package_records(file, run["first"], records_per_task, read_bytes):
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow[kinds[n]]) for n in names], names)

    return runs.repartition(tasks, "package", "first").mapInArrow(read, ", ".join(f"{n} {kinds[n]}" for n in names))


def index_lines(file, listing: Member, blocks: Member | None, first: int, count: int | None) -> list[bytes]:
    """The lines ``first`` to ``first + count`` of an index, by its blocks if it lists them."""
    start, last = data_offset(file, listing), None if count is None else first + count
    if blocks is None:
        return file.read_at(listing.size, start).splitlines()[first:last]
    listed = [json.loads(x) for x in file.read_at(blocks.size, data_offset(file, blocks)).splitlines()]
    ends = [b["first"] for b in listed[1:]] + [None]
    wanted = [b for b, end in zip(listed, ends) if (end is None or end > first) and (last is None or b["first"] < last)]
    if not wanted:
        return []
    low, high = wanted[0]["offset"], wanted[-1]["offset"] + wanted[-1]["length"]
    skipped = wanted[0]["first"]
    return file.read_at(high - low, start + low).splitlines()[first - skipped : None if last is None else last - skipped]


def package_records(file, first: int = 0, count: int | None = None, read_bytes: int = 4 << 20) -> Iterator[list[dict]]:
    """Lists of parsed records of one open package, by reads of about ``read_bytes``.

    All indexes below ``indexes/`` are followed in the order of their names, each line to the archive that it names (the only one, if it names none);
    ``first`` and ``count`` number the lines of all indexes.
    """
    members = {m.name: m for m in central_directory(file, file.size())}
    archives = {n.removeprefix("archive/"): m for n, m in members.items() if n.startswith("archive/") and not n.endswith("/")}
    indexes = sorted(n for n in members if n.startswith("indexes/") and not n.endswith(("/", BLOCKS)))
    if not archives or not indexes:
        raise ArchiveError("no archive or no index")
    lines: list[bytes] = []
    if len(indexes) == 1:
        lines = index_lines(file, members[indexes[0]], members.get(indexes[0] + BLOCKS), first, count)
    else:
        for name in indexes:
            lines += index_lines(file, members[name], None, 0, None)
        lines = lines[first : None if count is None else first + count]
    entries = [json.loads(line[line.index(b"{") :]) for line in lines if b"{" in line]
    only = next(iter(archives)) if len(archives) == 1 else None
    by_archive: dict[str, list[tuple[int, int]]] = {}
    for e in entries:
        name = e.get("filename", only)
        if name not in archives:
            raise ArchiveError(f"the index names {name}, which isn't there")
        by_archive.setdefault(name, []).append((int(e["offset"]), int(e["length"])))
    for name, where in sorted(by_archive.items()):
        data, start = archives[name], data_offset(file, archives[name])
        where.sort()
        while where:
            n = 1
            while n < len(where) and where[n][0] + where[n][1] - where[0][0] <= read_bytes:
                n += 1
            low, high = where[0][0], where[n - 1][0] + where[n - 1][1]
            if high > data.size:
                raise ArchiveError("the index points behind the archive")
            block = file.read_at(high - low, start + low)
            yield [parse(zlib.decompress(block[o - low : o - low + k], 31)) for o, k in where[:n]]
            where = where[n:]


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Archives all pages and returns what reading the archives gives, without the payloads.

    A null html is the empty payload, a null url gives a record without one. Rows without a page_id are always
    responses; rows that repeat id and payload are alike, and rows of one id with different payloads have their own records. No pages, no rows.
    """
    path = new_path(pages.sparkSession, "archives")
    packages = write_packages(pages, path, min_bytes)
    return read_packages(packages, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
