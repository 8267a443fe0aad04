import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from filigraph.llm import exact_dedup
from filigraph.llm.exact_dedup import shrink

SCHEMA = "doc_id long, text string, lang string, source string, digest int, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], SCHEMA)


@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), max_size=200), st.integers(1, 4))
def test_misra_gries_error_is_bounded(items, k):
    counts = {}
    for at in range(0, len(items), 7):
        for x in items[at : at + 7]:
            counts[x] = counts.get(x, 0) + 1
        counts = shrink(counts, k)
    assert len(counts) <= k
    for x in set(items):
        assert items.count(x) - len(items) / (k + 1) <= counts.get(x, 0) <= items.count(x)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_equals_brute_force(spark, counters):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(300)] + [(500, None), (501, ""), (502, "Ü" * 3000), (503, "Ü" * 3000), (None, "t1"), (None, "alone"), (7, "t7"), (7, "t7")]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(frame(spark, rows), counters=counters).collect()
    want = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_drop_copies_keeps_columns(spark):
    out = exact_dedup.drop_copies(frame(spark, [(1, "a"), (2, "a"), (3, None), (4, "")]))
    assert out.columns == ["doc_id", "text", "lang", "source", "digest", "kept"]
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 4]


def brute_drop(rows):
    """One row of each text, by the largest id that is not null."""
    best = {}
    for i, t in rows:
        t = t or ""
        best[t] = i if t not in best or best[t] is None or (i is not None and i > best[t]) else best[t]
    return sorted(map(repr, ((i, t) for t, i in best.items())))


@pytest.mark.parametrize("small_rows", [0, 1000])
def test_drop_copies_by_row(spark, monkeypatch, small_rows):
    from filigraph.llm import shared

    monkeypatch.setattr(exact_dedup, "keep_rows", lambda d, v, i, t: shared.keep_rows(d, v, i, t, small_rows))
    rows = [(1, "a"), (1, "b"), (2, "a"), (5, "q"), (5, "q"), (None, "n"), (None, "n"), (None, "a"), (None, "q"), (7, None), (8, ""), (8, ""), (9, "long " * 20_000), (9, "x")]
    docs = frame(spark, rows).withColumnsRenamed({"kept": "key", "lang": "stays"})
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(repr((r["doc_id"], r["text"] or "")) for r in out.collect()) == brute_drop(rows)
