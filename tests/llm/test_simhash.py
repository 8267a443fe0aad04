import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from filigraph.llm import simhash

SCHEMA = "doc_id long, text string, fp string, rep int"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, distance=4):
    ids = list(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB É\t\n\x0b\x1c  z", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint(text) == whole == brute_print(text)


@pytest.mark.parametrize("n", [10, 2**29, 2**35, 2**45])
def test_radii_cover_the_distance(n):
    plan = simhash.segmentation(n, 4)
    assert sum(b for _, b, _ in plan) == 64 and sum(r + 1 for *_, r in plan) == 5
    assert len({1 << s for s, *_ in plan}) == len(plan)


def near_prints(seed, n=300):
    rnd = random.Random(seed)
    out = {0: 0, 1: 0b111, 2: rnd.getrandbits(64)}
    centres = [rnd.getrandbits(64) for _ in range(12)]
    for i in range(3, n):
        x = rnd.choice(centres) if i % 3 else rnd.getrandbits(64)
        for b in rnd.sample(range(64), rnd.randrange(7)):
            x ^= 1 << b
        out[i] = x
    return out


@pytest.mark.parametrize("count, heavy", [(4, 65_536), (3, 65_536), (2, 65_536), (4, 2)])
def test_links_span_all_pairs(spark, monkeypatch, count, heavy):
    prints = near_prints(count)
    whole = simhash.segmentation(10, 4)
    base, extra = divmod(4, count)
    bits = [64 // count + (i < 64 % count) for i in range(count)]
    plan = [(sum(bits[i + 1 :]), b, base if i <= extra else base - 1) for i, b in enumerate(bits)]
    assert count != 4 or plan == whole
    monkeypatch.setattr(simhash, "segmentation", lambda n, d: plan)
    by_print = {}
    for i, x in prints.items():
        by_print[x] = min(i, by_print.get(x, i))
    rows = [(int(np.uint64(x).view(np.int64)), i) for x, i in by_print.items()]
    distinct = spark.createDataFrame(rows, "fp long, rep long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(distinct, 4, heavy)).collect()}
    want = brute_components({i: x for x, i in by_print.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert simhash.components(edges.where("false")).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = brute_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_edges_of_the_input(spark):
    rows = [(5, None, "x", 1), (3, " \t", "x", 1), (9, "a b c d e f", "x", 1), (9, "a b c d e f", "x", 1), (None, "a b c d e f", "x", 1), (2, "word " * 50_000, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 9), (None, None), (2, 2)}
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 9]
