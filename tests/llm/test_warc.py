import hashlib
import io
import zipfile
import zlib

import pytest

from filigraph.llm import queries, warc
from tests.oracle import assert_same

SCHEMA = "page_id long, url string, html string, refers_to string, digest int"


class Bytes:
    """A file in memory with the calls that the reader makes."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_directory_of_common_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"one")
        z.writestr(zipfile.ZipInfo("b/ü.bin"), b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 a comment"
    file = Bytes(out.getvalue())
    first, second = warc.central_directory(file, file.size())
    assert first.name == "a.txt" and file.read_at(3, warc.data_offset(file, first)) == b"one" and second.name == "b/ü.bin"
    with pytest.raises(warc.ArchiveError):
        warc.data_offset(file, second)
    with pytest.raises(warc.ArchiveError):
        warc.central_directory(Bytes(b"no zip at all"), 13)


def test_written_package_is_a_zip64_that_others_read():
    out = io.BytesIO()
    z = warc.ZipWriter(out)
    for name, data in (("x", b"12"), ("y", b"")):
        z.begin(name)
        z.data(data)
        z.end()
    z.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as other:
        assert other.testzip() is None and other.read("x") == b"12" and other.namelist() == ["x", "y"]
    members = warc.central_directory(Bytes(out.getvalue()), len(out.getvalue()))
    assert [(m.name, m.size, m.crc) for m in members] == [("x", 2, zlib.crc32(b"12")), ("y", 0, 0)]


def test_record_round_trip_and_damage():
    data = warc.record(3, "http://x/ä b\r\n", "é".encode(), None, "2020-01-01T00:00:00Z")
    got = warc.parse(data)
    assert got["page_id"] == 3 and got["payload"] == "é".encode() and got["payload_digest"] == hashlib.sha1("é".encode()).hexdigest()
    assert "%0D%0A" in got["url"]
    assert warc.parse(warc.record(1, None, b"abc", 9, "d"))["refers_to"] == 9 and warc.parse(warc.record(1, None, b"abc", 9, "d"))["payload_bytes"] == 3
    with pytest.raises(warc.ArchiveError):
        warc.parse(data.replace("é".encode(), b"ee"))
    with pytest.raises(warc.ArchiveError):
        warc.parse(data[:-8])


def test_round_trip_of_all_kinds(spark, tmp_path):
    big = "x" * 1000
    rows = [(1, "http://a", big, "c", 1), (2, None, big, "c", 1), (3, "http://a b", None, "c", 1), (4, "u", "", "c", 1), (5, "u", "x" * 999, "c", 1), (6, "u", "x" * 999, "c", 1), (None, "u", big, "c", 1), (2, None, big, "c", 1), (7, "u", "é" * 500, "c", 1)]
    pages = spark.createDataFrame(rows, SCHEMA)
    path = f"file://{tmp_path}/zips"
    packages = warc.write_packages(pages, path, max_bytes=600)
    back = warc.read_packages(packages, path, records_per_task=2, read_bytes=300).collect()
    by = {r["page_id"]: r for r in back}
    assert len(back) == 9 and by[1]["record_type"] == "revisit" and by[1]["refers_to"] == 2 and by[1]["payload"] is None
    assert by[2]["payload"] == big.encode() and by[7]["payload"] == ("é" * 500).encode() and by[3]["payload"] == b"" and by[None]["record_type"] == "response"
    assert {by[5]["record_type"], by[6]["record_type"]} == {"response"} and packages.count() >= 1
    assert warc.round_trip(pages.where("false")).count() == 0


def test_query_equals_sql(spark, sf):
    assert_same(queries.op2_warc(spark, sf), queries.OP2_SQL, sf)
    assert_same(queries.op3_exact_dedup(spark, sf), queries.OP3_SQL, sf)


@pytest.mark.parametrize("small_rows", [0, 100])
def test_repeated_ids_lose_no_payload(spark, tmp_path, small_rows):
    x, y = "x" * 1200, "y" * 1500
    rows = [(1, x), (1, "small other text"), (2, x), (3, y), (3, x), (4, y), (None, x), (3, x)]
    pages = spark.createDataFrame([(i, "u", h, "c", 1) for i, h in rows], SCHEMA)
    path = f"file://{tmp_path}/zips"
    back = warc.read_packages(warc.write_packages(pages, path, small_rows=small_rows), path).collect()
    last = {x: 3, y: 4}
    want = [(i, hashlib.sha1(h.encode()).hexdigest(), last[h] if h in last and i is not None and i < last[h] else None) for i, h in rows]
    assert sorted(map(repr, ((r["page_id"], r["payload_digest"], r["refers_to"]) for r in back))) == sorted(map(repr, want))
    stored = {(r["page_id"], bytes(r["payload"]).decode()) for r in back if r["record_type"] == "response"}
    assert {(1, "small other text"), (3, x), (4, y), (None, x)} == stored


def test_blocks_of_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "INDEX_BLOCK", 3)
    out = io.BytesIO()
    z = warc.ZipWriter(out)
    z.begin(warc.INDEX)
    for block in (b"a {1}\nb {2}\nc {3}\n", b"d {4}\n"):
        z.data(block)
    z.end()
    z.begin(warc.INDEX + warc.BLOCKS)
    z.data(b'{"first": 0, "offset": 0, "length": 18}\n{"first": 3, "offset": 18, "length": 6}\n')
    z.end()
    z.close()
    file = Bytes(out.getvalue())
    listing, blocks = warc.central_directory(file, file.size())
    lines = [b"a {1}", b"b {2}", b"c {3}", b"d {4}"]
    for first in range(5):
        for count in (None, 1, 2, 4):
            want = lines[first:] if count is None else lines[first : first + count]
            assert warc.index_lines(file, listing, blocks, first, count) == want == warc.index_lines(file, listing, None, first, count)


def test_package_with_several_archives():
    out, index = io.BytesIO(), b""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, ids in (("one.warc.gz", (1, 2)), ("two.warc.gz", (3,))):
            data = b""
            for i in ids:
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(warc.record(i, "http://x", b"p%d" % i, None, "d")) + packer.flush()
                index += b'com,x)/ 2024 {"offset": "%d", "length": "%d", "filename": "%s"}\n' % (len(data), len(packed), name.encode())
                data += packed
            z.writestr(f"archive/{name}", data)
        z.writestr("indexes/all.cdxj", b"!meta line\n" + index)
    got = [r for rows in warc.package_records(Bytes(out.getvalue())) for r in rows]
    assert [(r["page_id"], r["payload"]) for r in got] == [(1, b"p1"), (2, b"p2"), (3, b"p3")]
    with pytest.raises(warc.ArchiveError):
        empty = io.BytesIO()
        zipfile.ZipFile(empty, "w").close()
        list(warc.package_records(Bytes(empty.getvalue())))
