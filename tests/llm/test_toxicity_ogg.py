import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filigraph.llm import ogg, toxicity


def brute_segments(scores):
    """All maximal segments by their definition: recursively the best segment, then both sides of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[0] + 1e-9 or abs(s - best[0]) < 1e-9 and (b - a) < best[2] - best[1]):
                best = (s, a, b)
    if best is None:
        return []
    _, a, b = best
    return brute_segments(scores[:a]) + [best] + [(s, x + b, y + b) for s, x, y in brute_segments(scores[b:])]


def test_segments_are_maximal():
    rnd = random.Random(5)
    for _ in range(200):
        scores = [round(rnd.uniform(-3, 3), 3) for _ in range(rnd.randrange(1, 14))]
        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(scores)]
        assert got == [(round(s, 6), a, b) for s, a, b in brute_segments(scores)]
    assert toxicity.segments([]) == [] and toxicity.segments([-1.0]) == []


def test_rate_solves_its_equation():
    import math

    rate = toxicity._decay({2.0: 0.01, 0.5: 0.02}, -0.2)
    assert 0.01 * math.exp(2 * rate) + 0.02 * math.exp(0.5 * rate) + 0.97 * math.exp(-0.2 * rate) == pytest.approx(1)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score_documents(docs, labels)
    rows = out.where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.85 and sum(r["predicted"] for r in clean) / len(clean) < 0.05
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_never_used(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.score_documents(docs, x).collect())) for x in (labels, turned))
    assert one == two and len(one) == docs.count()


def test_edges_of_the_input(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame([(None, "x", "e"), (1, None, "e"), (1, None, "e"), (2, "", "e"), (3, "word " * 100_000, "e")], "doc_id long, text string, score string")
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 5 and all(r["score"] is not None for r in rows)
    assert toxicity.score_documents(docs.where("false"), labels).count() == 0
    assert toxicity.score_documents(docs, labels.where("false")).count() == 5
    kept = toxicity.drop_toxic(docs, labels.where("false"))
    assert kept.columns == docs.columns


def test_spans_point_at_words(spark):
    model = toxicity.Model({"bad": 4.0, "awful": 4.0}, -0.01, rate=2.0, ln_k=-3.0, slope=2.0, offset=-2.0)
    text = "All fine here. Bad and AWFUL words, then calm again."
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, with_spans=True).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["Bad and AWFUL"] and row["predicted"] == 1


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=60))
def test_checksum(data):
    assert ogg.checksum(data) == slow_checksum(data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 800), min_size=1, max_size=30), st.data())
def test_packets_come_back(sizes, data):
    packets = [(bytes([i % 251]) * n, i) for i, n in enumerate(sizes)]
    pages = ogg.paginate(packets, 7)
    stream = ogg.decode(b"".join(p for _, p in pages))[7]
    assert stream.packets == [p for p, _ in packets] and stream.pages == len(pages) and stream.ended


@pytest.mark.parametrize("size", [0, 1, 254, 255, 256, 65_025, 65_026, 200_000])
def test_round_trip(size):
    payload = bytes(i * 7 % 256 for i in range(size))
    samples, info = ogg.read_media(ogg.encode(payload))
    assert samples == payload and info["seconds"] == size / ogg.RATE


def test_damage_is_found():
    data = ogg.encode(bytes(range(200)) * 400)
    for at in (0, 5, 30, len(data) // 2, len(data) - 1):
        with pytest.raises(ogg.OggError):
            ogg.read_media(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    pages = [p for _, p in ogg.paginate([(b"x" * 70_000, 0)], 1)]
    for bad in (b"".join(pages[1:]), pages[0], b"".join(pages)[:-1], b"".join([*pages, pages[-1]])):
        with pytest.raises(ogg.OggError):
            ogg.decode(bad)


def test_ogg_query(spark):
    docs = spark.createDataFrame([(1, "héllo", 1), (2, "héllo", 1), (3, None, 1), (None, "", 1), (5, "x" * 200_000, 1)], "doc_id long, text string, media int")
    rows = {r["doc_id"]: r for r in ogg.ogg_features(docs).collect()}
    data = "héllo".encode().ljust(64, b"\0")
    assert rows[1]["n_bytes"] == 6 and rows[1]["payload_bytes"] == 64 and rows[1]["payload_sha256"] == hashlib.sha256(data).hexdigest() and rows[1]["tail_crc32"] == zlib.crc32(data)
    assert rows[1]["media_sha256"] == hashlib.sha256(ogg.encode(data)).hexdigest() and rows[1]["media_bytes"] == len(ogg.encode(data))
    assert [x for k, x in enumerate(rows[1]) if k] == [x for k, x in enumerate(rows[2]) if k] and rows[3]["feature"] == rows[None]["feature"] and rows[5]["payload_bytes"] == 200_000
    assert ogg.ogg_features(docs.where("false")).count() == 0
