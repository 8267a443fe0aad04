"""Ogg files read by a decoder of its own, byte by byte, and the times of packets."""

import hashlib
import math
import zlib

import pytest

from filigraph.llm import ogg


def plain_reader(data):
    """(serial, [packet bytes], [(granule, packets finished so far)]) of each stream, without checksums."""
    streams, at = {}, 0
    while at < len(data):
        assert data[at : at + 4] == b"OggS" and data[at + 4] == 0
        granule = int.from_bytes(data[at + 6 : at + 14], "little", signed=True)
        serial = int.from_bytes(data[at + 14 : at + 18], "little")
        count = data[at + 26]
        sizes = list(data[at + 27 : at + 27 + count])
        at += 27 + count
        packets, marks = streams.setdefault(serial, ([b""], []))
        for size in sizes:
            packets[-1] += data[at : at + size]
            at += size
            if size < 255:
                packets.append(b"")
        marks.append((granule, len(packets) - 1))
    return {k: (p[:-1], m) for k, (p, m) in streams.items()}


def plain_features(text):
    """What the query gives for a text, by plain loops."""
    raw = (text or "").encode()
    data = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    media = ogg.encode(data)
    streams = plain_reader(media)
    (packets, marks), = [s for s in streams.values() if s[0][0].startswith(b"PCM")]
    assert b"".join(packets[1:]) == data
    pages = sum(len(m) for _, m in streams.values())
    end = {}
    for granule, finished in marks:
        if granule >= 0:
            end[finished - 1] = granule
    starts, at = [], 0
    for i, p in enumerate(packets[1:], 1):
        starts.append(at)
        at += len(p)
        assert i not in end or end[i] == at
    mean = sum(data) / len(data)
    rms = math.sqrt(sum((b - 128) ** 2 for b in data) / len(data))
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
    longest = max(len(p) for p in packets[1:])
    feature = f"rate=8000;seconds={len(data) / 8000:.6f};packets={len(packets) - 1};last_start={starts[-1] / 8000:.6f};longest={longest / 8000:.6f};pages={pages};mean={mean:.6f};rms={rms:.6f};peak={max(data)};crossings={crossings}"
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def test_query_equals_plain_loops(spark, sf):
    from filigraph.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_ogg(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == plain_features(texts[r["doc_id"]])


def test_stored_form_is_as_the_format_says():
    """The bytes of a small file, field by field."""
    data = ogg.encode(b"abc", packet=8)
    streams = plain_reader(data)
    serial = zlib.crc32(b"abc")
    assert set(streams) == {serial, serial ^ 0xFFFFFFFF}
    head = b"PCM     " + bytes([0, 0, 0, 0, 0, 0, 0, 1]) + (8000).to_bytes(4, "big") + bytes([8, 1]) + (8).to_bytes(2, "big") + bytes(4)
    assert streams[serial] == ([head, b"abc"], [(0, 1), (3, 2)]) and streams[serial ^ 0xFFFFFFFF] == ([b"NOTE\0", b"LENGTH=3"], [(0, 1), (0, 2)])
    assert data[5] == 2 and data.count(b"OggS") == 4


def test_packets_within_a_page_get_times():
    payload = bytes(range(250)) * 4
    stream = ogg.decode(ogg.encode(payload, packet=100))[zlib.crc32(payload)]
    assert -1 in stream.granules and ogg.packet_samples(stream) == [(i * 100, i * 100 + 100) for i in range(10)]
    samples, info = ogg.read_media(ogg.encode(payload, rate=1000, packet=100))
    assert samples == payload and info["times"] == [(i / 10, (i + 1) / 10) for i in range(10)] and info["seconds"] == 1.0


def test_granules_that_do_not_fit():
    stream = ogg.Stream([b"head", b"x" * 10, b"y" * 10], [0, 10, 21])
    with pytest.raises(ogg.OggError):
        ogg.packet_samples(stream)
    with pytest.raises(ogg.OggError):
        ogg.packet_samples(ogg.Stream([b"head", b"x" * 10], [0, -1]))


def test_packet_table(spark):
    docs = spark.createDataFrame([(1, "x" * 20_000), (None, None)], "doc_id long, text string")
    rows = ogg.packets(ogg.encode_column(docs)).collect()
    one = sorted((r["packet"], r["start_s"], r["end_s"], r["n_bytes"]) for r in rows if r["doc_id"] == 1 and r["stream"] == "pcm")
    assert one == [(0, 0.0, 1.024, 8192), (1, 1.024, 2.048, 8192), (2, 2.048, 2.504, 3648)]
    assert sorted((r["stream"], r["n_bytes"]) for r in rows if r["doc_id"] is None) == [("comment", 9), ("pcm", 64)]
    assert ogg.packets(ogg.encode_column(docs.where("false"))).count() == 0
