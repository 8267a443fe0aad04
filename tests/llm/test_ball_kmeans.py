"""Ball k-means against all distances, by plain loops and by SQL."""

import hashlib
import random

import numpy as np
import pytest

from filigraph.llm import ball_kmeans, queries
from tests.oracle import assert_same

SCHEMA = "vec_id long, embedding array<double>"


def floor_of(x, scale):
    return int(np.floor(np.float64(x) * scale))


def plain(rows, k, dims, rounds, scale=256, seed=2):
    kept = [(i, [floor_of(x, scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centroids)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in last:
        inertia[j] = inertia.get(j, 0) + d
    shown = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, j, d, shown(inertia[j]), shown(sum(inertia.values())), digest[j]) for i, d, j in last], key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("spread", [0.001, 0.05, 3.0])
def test_equals_all_distances(spark, spread):
    rng = random.Random(int(spread * 1000))
    middles = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, spread) for m in middles[i % 6]]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert rows_of(ball_kmeans.cluster(df, k=9, dims=4, rounds=4)) == plain(rows, 9, 4, 4)


def test_ties_repeats_nulls_and_a_hot_vector(spark):
    grid = [(i, [float(i % 5), float(i // 5 % 5)]) for i in range(100)]  # many points halfway between centroids
    rows = grid + [(7, [1.0, 1.0])] * 120 + [(None, [2.0, 2.0]), (None, None), (1, None), (2, [1.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cluster", "2 AS distance", "3 AS v").repartition(5)
    got = rows_of(ball_kmeans.cluster(df, k=8, dims=2, rounds=5, scale=2))
    assert got == plain(rows, 8, 2, 5, scale=2) and len(got) == 221


def test_large_components_and_few_vectors(spark):
    rows = [(i, [1e9 * (i % 3), -3e8 * i]) for i in range(9)] + [(20, [1e15, -1e15]), (21, [1e15, 1e14])]
    assert rows_of(ball_kmeans.cluster(spark.createDataFrame(rows[:9], SCHEMA), k=3, dims=2, rounds=2, scale=1)) == plain(rows[:9], 3, 2, 2, scale=1)
    far = {r[0]: r for r in ball_kmeans.cluster(spark.createDataFrame(rows, SCHEMA), k=2, dims=2, rounds=2).collect()}
    want = {r[0]: r for r in plain(rows, 2, 2, 2)}
    assert {i: r["cluster"] for i, r in far.items()} == {i: r[1] for i, r in want.items()}
    assert all(r["distance"] == (d if (d := want[i][2]) < 1 << 63 else None) for i, r in far.items())
    assert rows_of(ball_kmeans.cluster(spark.createDataFrame(rows[:2], SCHEMA), k=40, dims=2)) == plain(rows[:2], 40, 2, 5)
    assert ball_kmeans.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ball_kmeans.cluster(spark.createDataFrame([(1, [1e300, 0.0])], SCHEMA), dims=2).collect() == []  # beyond 64 bits


def test_balls_spare_comparisons():
    """Members of the stable core are compared with their own centroid only; neighbours lie within twice the radius."""
    balls = ball_kmeans.Balls.of([[0, 0], [10, 0], [100, 0]], [36, 36, 4])
    assert balls.neighbours == [[1], [0], []]
    best, square = ball_kmeans.nearest(np.array([[1, 0], [5, 0], [6, 0]]), np.zeros(3, dtype=np.int64), balls)
    assert best.tolist() == [0, 0, 1] and square.tolist() == [1, 25, 16]


def test_query_equals_sql(spark, sf):
    assert_same(queries.op12_ball_kmeans(spark, sf), queries.kmeans_sql(40, 64, 5, 256, 2), sf)
