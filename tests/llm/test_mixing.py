from collections import defaultdict

import duckdb
import pytest

from filigraph.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, block string"
WEIGHTS = (3, 1, 2)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], SCHEMA)


def fair_targets(sizes):
    """The rule by hand: deal by weight, hold what reaches twice its size, deal the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, budget, open_ = {s: 0.0 for s in sizes}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        share = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def check(rows, docs):
    assert len(rows) == len(docs)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s in docs}
    for i, t, s in docs:
        n = len((t or "").split())
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = fair_targets(dict(sizes))
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_targets_and_rounding(spark):
    docs = [(i, "w " * (1 + i * 7919 % 50), f"s{i % 4}" if i % 3 else "hot") for i in range(2000)] + [(9000, None, "s1"), (9001, "", None), (9002, "a b\x0bc d", None), (9003, "word " * 5000, "tiny")]
    first = mixing.mix(frame(spark, docs)).collect()
    check(first, docs)
    again = mixing.mix(frame(spark, docs[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_no_bias(spark):
    """Over many seeds a document is taken as often as its share asks."""
    docs = frame(spark, [(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(40)]).cache()
    total = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix(docs, seed=seed * 1000).collect():
            total[r["doc_id"]] += r["taken"] / r["size"] - r["target"] / r["source_size"]
    assert abs(sum(total.values()) / len(total)) < 0.6 and max(map(abs, total.values())) < 8


def test_small_and_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    only = mixing.mix(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_apply_repeats_rows(spark):
    docs = frame(spark, [(i, "a b c", "s") for i in range(100)] + [(500, None, "s")])
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id < 500").count() == 150 and out.where("doc_id = 500").count() == 1


def test_sizes_equal_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = duckdb.sql(rf"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) FROM '{sf}/documents.parquet'").fetchall()
    assert {(r["doc_id"], r["size"]) for r in mixing.mix(docs).collect()} == set(want)
    check(mixing.mix(docs).collect(), [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_native_plan(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("small_rows", [0, 1000])
def test_apply_by_row_takes_what_the_mix_takes(spark, small_rows):
    rows = [(7, "w " * (1 + i % 13), "s") for i in range(300)] + [(None, "a b", None)] * 150 + [(i, "c d e", "t") for i in range(1000, 1090)] + [(8, None, "t"), (8, "", "t"), (8, "x", "t")]
    docs = frame(spark, rows).withColumnsRenamed({"size": "col", "block": "key"}).cache()
    mixed, out = mixing.mix(docs).collect(), mixing.apply_mix(docs, small_rows)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[(r["doc_id"], r["source"], len((r["text"] or "").split()))] += 1
    want = defaultdict(int)
    for r in mixed:
        want[(r["doc_id"], r["source"], r["size"])] += r["taken"] // r["size"] if r["size"] else 1
    assert got == {k: n for k, n in want.items() if n}
    assert sum(k[2] * n for k, n in got.items()) == sum(r["taken"] for r in mixed)


def test_repeated_rows_are_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_RUN", 100)
    rows = mixing.numbered(spark.createDataFrame([(None, "s", 5)] * 640 + [(1, "s", 5), (1, None, 5), (1, None, 5)], "doc_id long, source string, size long"))
    got = sorted(map(repr, map(tuple, rows.collect())))
    assert got == sorted(map(repr, [(None, "s", 5, i) for i in range(640)] + [(1, "s", 5, 0), (1, None, 5, 0), (1, None, 5, 1)]))
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in rows.where("doc_id is null").groupBy(F.pmod(F.xxhash64(*mixing._NAME), F.lit(20)).alias("b")).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 64


def test_ranks(spark):
    names = [f"n{i * 7919 % 1000:04d}" for i in range(1000)] + [None]
    out = mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string"), "source", "place").collect()
    order = sorted(n for n in names if n is not None) + [None]
    assert {r["source"]: r["place"] for r in out} == {n: i for i, n in enumerate(order)}
