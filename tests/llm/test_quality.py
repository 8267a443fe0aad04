"""Quality: trees against node-by-node walks and a brute-force split, statistics by hand, held-out accuracy."""

import math
import zlib

import numpy as np
import pytest

from filigraph.llm import quality, queries


def walk(trees, root, row):
    node = root
    while trees.left[node] != node:
        node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
    return trees.value[node]


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 5)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(int)
    return x, y, np.arange(900) % 5 == 4


def test_flat_arrays_equal_walks(made):
    x, y, check = made
    trees = quality.grow(x, y, check, max_trees=30)
    slow = np.array([trees.base + sum(walk(trees, r, row) for r in trees.roots) for row in x])
    assert np.allclose(trees.margins(x), slow)
    assert ((trees.probabilities(x[check]) >= 0.5) == y[check]).mean() > 0.97
    assert trees.margins(x[:0]).shape == (0,)


def test_first_split_is_the_best_of_all(made):
    """With as many bins as values, the root splits where the sum of squared gradients over weights gains most."""
    x, y, _ = made
    trees = quality.grow(x, y, np.zeros(900, dtype=bool), max_trees=1, max_bins=1000, leaves=2, least=0.0)
    p = y.mean() * 900 / 901 + 0.5 / 901
    g, h = p - y, np.full(900, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(((gain(x[:, f] <= t) + gain(x[:, f] > t), f, t) for f in range(5) for t in np.unique(x[:, f])[:-1]), key=lambda b: b[0])
    assert (trees.feature[0], trees.threshold[0]) == (best[1], best[2])
    left = x[:, best[1]] <= best[2]
    assert trees.value[1] == pytest.approx(-0.1 * g[left].sum() / (h[left].sum() + 1), rel=1e-6)


def test_one_class_or_none_gives_the_base_rate():
    for y in ([1, 1, 1], [0], []):
        trees = quality.grow(np.zeros((len(y), 2)), np.array(y, dtype=int), np.zeros(len(y), dtype=bool))
        ones = sum(y)
        assert trees.probabilities(np.zeros((1, 2)))[0] == pytest.approx((ones + 0.5) / (len(y) + 1))


def test_statistics_by_hand():
    at = dict(zip(quality.FEATURES, quality.statistics("One two. ONE one two\n\n- x9 x9 x9|\none two\none two")))
    assert at["words"] == pytest.approx(math.log(14)) and at["distinct_words"] == 8 / 13 and at["repeated_neighbours"] == 1 / 13
    assert at["repeated_lines"] == 1 / 4 and at["blank_lines"] == 1 / 5 and at["marked_lines"] == 1 / 4 and at["pipes"] == 1 / 13
    assert at["top_word"] == 3 / 13 and at["top_pair"] == 3 / 13 and at["digit_words"] == 3 / 13 and at["upper_words"] == 1 / 13
    for text in ("", " ", "\n\n", "a", "\ud800", "ß" * 50_000, "word " * 200_000):
        assert len(quality.statistics(text)) == len(quality.FEATURES) and np.isfinite(quality.statistics(text)).all()


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "a b", 2), (None, "x", 3), (2, "", 4), (5, "b " * 60_000, 5)], "doc_id long, text string, label int").selectExpr("*", "0.5 AS score", "1 AS fold", "2 AS m0")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (2, None, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "5", "None"] and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert quality.score_documents(docs.limit(0), labels).collect() == [] and quality.score_documents(docs, labels.limit(0)).count() == 5
    assert quality.keep_good(docs, labels.limit(0), least=0.4).columns == docs.columns


def test_held_out_rows_do_not_teach(spark, sf):
    """Turning the labels of held-out rows around changes no score."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - labels["quality"]).otherwise(labels["quality"]))
    scores = [sorted((r["doc_id"], r["score"]) for r in quality.score_documents(docs, x, max_trees=20).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op13_quality(spark, sf).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(p == y for _, y, p in held) / len(held) > 0.93
