import random

import numpy as np

import corpus_pipeline
from filigraph.llm import simhash


def runs(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def share(a, b):
    return len(a & b) / len(a | b)


def brute_kept(texts):
    sets = {i: runs(t) for i, t in texts.items()}
    links = {(a, b) for a in sets for b in sets if a > b and share(sets[a], sets[b]) >= 0.8}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {root(i) for i in sets}


def test_near_copies_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    unique = corpus_pipeline.exact_dedup_stage(spark, docs, sf).cache()
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, unique, sf).collect()}
    assert kept == brute_kept({r["doc_id"]: r["text"] or "" for r in unique.collect()})


def test_copies_of_080_to_090_go(spark):
    rng = random.Random(3)
    texts = {}
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts[base] = " ".join(words)
        for copy in range(1, 4):  # 2 to 6 changed words leave about 0.9 to 0.74 of the runs
            changed = list(words)
            for at in rng.sample(range(10, 190), 2 * copy):
                changed[at] = f"x{rng.randrange(10**6)}"
            texts[base + 100 * copy] = " ".join(changed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()}
    assert kept == brute_kept(texts) and 40 <= len(kept) < 120


def test_odd_rows(spark):
    rows = [(1, " "), (2, None), (3, "!"), (None, ""), (3, ""), (3, "!"), (7, "a b c d e f g"), (8, "a b c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.drop_near_copies(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(1, " "), (3, "!"), (None, ""), (7, "a b c d e f g"), (8, "a b c d e f g h")], key=repr)
    assert simhash.drop_near_copies(docs.where("false")).count() == 0


def test_ones_and_wide_fingerprints():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2**64, (1000, 3), np.uint64)
    want = [sum(int(r[b // 64]) >> (63 - b % 64) & 1 for r in rows) for b in range(192)]
    assert simhash.ones(rows).tolist() == want
    hashes = np.unique(rng.integers(0, 2**64, 700, np.uint64))
    near = np.unique(np.concatenate([hashes[70:], rng.integers(0, 2**64, 70, np.uint64)]))
    apart = [int(np.bitwise_count(simhash.wide_fingerprint(x, 32) ^ simhash.wide_fingerprint(hashes, 32)).sum()) for x in (hashes, near, rng.integers(0, 2**64, 700, np.uint64))]
    assert apart[0] == 0 and 150 < apart[1] < 420 and 900 < apart[2] < 1150  # 2048 bits; 0.144 of them at 0.9 of the set


def brute_near(entries, probes, bits, reach):
    pairs = [(a, b) for i, a in enumerate(entries) for b in entries[:i] if (a[0] ^ b[0]).bit_count() <= 1] + [(p, e) for p in probes for e in entries if p[0] == e[0]]
    return {tuple(sorted((a[1], b[1]))) for a, b in pairs if (a[2] ^ b[2]).bit_count() + (a[3] ^ b[3]).bit_count() <= reach}


def test_entries_of_balls_are_spanned():
    rng = random.Random(4)
    centres = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(6)]

    def entry(key):
        a, b = rng.choice(centres)
        return (rng.getrandbits(4), key, a ^ (1 << rng.randrange(64)), b ^ (1 << rng.randrange(64)))

    entries, probes = [entry(i) for i in range(120)], [entry(i) for i in range(200, 230)]
    frames = [np.array(x, simhash._ENTRY) for x in (entries, probes)]
    for block in (7, 1_000_000):
        links = simhash.near_entries(*frames, 4, 3, block)
        want = brute_near(entries, probes, 4, 3)
        assert {tuple(sorted(x)) for x in links} <= want and len(links) < len(entries) + len(probes)
        assert closure(links) == closure(want)


def closure(links):
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {i: root(i) for i in up}


def test_prefixes_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = {}
    for i in range(120):  # one cluster of many blocks, and texts of their own
        words = list(base) if i % 4 else [f"u{rng.randrange(10**5)}" for _ in range(100)]
        for at in rng.sample(range(len(words)), rng.randrange(5)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_kept(texts)
    plan, links = simhash.wide_plan, simhash.similar_links
    assert plan(10_000_000, 0.8).prefix > 0 and plan(100, 0.8).prefix == 0
    monkeypatch.setattr(simhash, "wide_plan", lambda n, s: plan(n, s, group=16))
    monkeypatch.setattr(simhash, "similar_links", lambda t, k, s: links(t, k, s, block=20))
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == want


def test_rows_of_one_id_keep_their_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, "another text of the same id here"), (2, long + " end"), (None, long), (None, long), (4, long), (4, long), (0, "x y")]
    twins = spark.createDataFrame([(7, long), (7, long + " end"), (9, long)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.drop_near_copies(twins).collect()] == [7]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, key string")
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, [(1, long), rows[1], (None, long), (0, "x y")]))


def test_odd_distances_of_heavy_buckets(spark):
    from tests.llm.test_simhash import brute_components, near_prints

    prints = near_prints(3, 200)
    rows = [(int(np.uint64(x).view(np.int64)), i) for i, x in prints.items()]
    distinct = spark.createDataFrame(rows, "fp long, rep long").dropDuplicates(["fp"])
    kept = {r["rep"]: prints[r["rep"]] for r in distinct.collect()}
    for distance in (3, 5):
        found = {r["node"]: r["component"] for r in simhash.components(simhash._ball_links(distinct.where("rep < 60") if distance == 5 else distinct, distance)).collect()}
        part = {i: x for i, x in kept.items() if i < 60} if distance == 5 else kept
        want = brute_components(part, distance)
        assert {i: found.get(i, i) for i in part} == want
