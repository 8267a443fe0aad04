"""The inverted-file index: all rows are in it, probes read cells alone, exact mode is exact, recall is measured."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigraph.operators import retrieval, vector_index as vi
from filigraph.sources import versions
from filigraph.work import new_path

SCHEMA = "vec_id long, ticker string, embedding array<float>"


def made(n, seed=1, first=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, 16)) * 3
    return [(first + i, f"T{i % 7}", (middles[i % 20] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def stored(spark):
    rows = made(1500) + [(9001, "T0", None), (9002, "T1", [1.0, 2.0]), (9003, "T1", [None] + [1.0] * 15)] + [(10_000 + i, "HOT", [1.0] * 16) for i in range(700)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    path = new_path(spark, "index")
    vi.build_index(vectors, path, cells=24, sort=["ticker"], file_rows=200)
    return vectors, vi.open_index(spark, path), path


def key(rows):
    return [(r["vec_id"], r["score"]) for r in rows]


def test_every_whole_vector_is_in_one_cell(stored):
    vectors, index, _ = stored
    assert index.rows.count() == 2200 and index.rows.select("vec_id").distinct().count() == 2200
    assert len(index.centroids) == 24 and 1 <= index.probes <= 24
    files = index.rows.where("ticker = 'HOT'").select("_metadata.file_path").distinct().count()
    assert files >= 4  # a hot cell is written by several tasks


def test_search_prunes_cells_and_filters(stored):
    vectors, index, _ = stored
    query = [float(x) for x in vectors.where("vec_id = 7").first()["embedding"]]
    exact = retrieval.nearest(vectors, query, 10).collect()
    assert key(vi.search(index, query, 10, exhaustive=True).collect()) == key(exact)
    found = vi.search(index, query, 10, where=F.col("ticker") == "T3", probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "EqualTo(ticker,T3)" in plan
    assert {r["ticker"] for r in found.collect()} == {"T3"}
    assert key(vi.search(index, query, 3000).collect()) == key(retrieval.nearest(vectors, query, 3000).collect())  # more than the cells hold: all are read
    assert key(vi.search(index, query, 5, where=F.col("ticker") == "none").collect()) == []


def test_batches_and_recall(stored):
    vectors, index, _ = stored
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = retrieval.nearest_to_each(vectors, queries, 10)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "vec_id", "score", "place").collect()))
    assert rows(vi.search_each(index, queries, 10, exhaustive=True, share_rows=300)) == rows(exact)
    assert rows(retrieval.nearest_to_each(vectors, queries, 10, tile=9, share_rows=400)) == rows(exact)  # tiles and shares
    assert vi.recall(vi.search_each(index, queries, 10), exact) >= 0.9
    assert vi.recall(vi.search_each(index, queries, 10, probes=1), exact) < vi.recall(vi.search_each(index, queries, 10, probes=12), exact) + 1e-9


def test_appended_rows_and_versions(spark, stored):
    vectors, index, path = stored
    more = spark.createDataFrame(made(100, seed=2, first=5000), SCHEMA)
    before = versions.published(spark, path)[-1]
    version = vi.append(spark, path, more)
    newer = vi.open_index(spark, path)
    assert version == before + 1 and newer.rows.count() == 2300 and vi.open_index(spark, path, before).rows.count() == 2200
    query = [float(x) for x in more.first()["embedding"]]
    assert key(vi.search(newer, query, 10, exhaustive=True).collect()) == key(retrieval.nearest(vectors.unionByName(more), query, 10).collect())
    assert index.rows.count() == 2200  # an open version stays what it was


def test_few_rows_none_and_length_one(spark):
    path = new_path(spark, "index")
    vi.build_index(spark.createDataFrame([], SCHEMA), path)
    assert vi.search(vi.open_index(spark, path), [1.0], 3).collect() == []
    path = new_path(spark, "index")
    vi.build_index(spark.createDataFrame([(1, "a", [3.0, 4.0]), (None, "b", [0.0, 0.0]), (1, "c", [5.0, 0.0])], SCHEMA), path, normalise=True)
    got = vi.search(vi.open_index(spark, path), [1.0, 0.0], 3).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (1, 0.6), (None, 0.0)]


def test_probes_reach_the_wanted_recall():
    sample = np.array([v for _, _, v in made(2000)], float)
    centroids = vi.fit_centroids(sample, 30)
    few, many = vi.probes_for(sample, centroids, 0.5), vi.probes_for(sample, centroids, 0.99)
    assert 1 <= few <= many <= 30 and np.allclose(np.linalg.norm(centroids, axis=1), 1)
