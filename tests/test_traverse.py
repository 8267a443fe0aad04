"""Paths, rank and components against plain versions on random graphs."""

import random
from collections import deque

import numpy as np
import pytest

from filigraph.operators import traverse
from filigraph.operators.graph import load
from filigraph.sources import graph_store
from filigraph.work import new_path


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(11)
    ids = [f"v{i}" for i in range(60)]
    pairs = {(r.choice(ids[:40]), r.choice(ids[:40])) for _ in range(70)} | {("hub", v) for v in ids[:15]} | {(v, "hub") for v in ids[20:24]} | {("x", "x"), ("p", "q"), ("q", "s"), ("s", "p")}
    edges = [(a, b, "r", i) for i, (a, b) in enumerate(sorted(pairs))]
    nodes = spark.createDataFrame([(v, "N", i) for i, v in enumerate(ids)], "id string, label string, ord long")
    g = load(nodes, spark.createDataFrame(edges, "src string, dst string, rel string, ord long"), write=True)
    return g, sorted({r["id"] for r in g.nodes.collect()}), sorted(pairs)


def reach(pairs, seed, directed):
    out, queue = {seed: 0}, deque([seed])
    while queue:
        v = queue.popleft()
        for a, b in pairs:
            for near in ([b] if a == v else []) + ([a] if b == v and not directed else []):
                if near not in out:
                    out[near] = out[v] + 1
                    queue.append(near)
    return out


@pytest.mark.parametrize("directed", [True, False])
def test_distances(spark, made, directed):
    g, _, pairs = made
    seeds = spark.createDataFrame([("hub",), ("v3",), ("v3",), ("p",), ("none",), (None,)], "seed string")
    rows = traverse.distances(g, seeds, directed=directed).collect()
    assert {(r["seed"], r["id"]): r["distance"] for r in rows} == {(s, v): d for s in ("hub", "v3", "p") for v, d in reach(pairs, s, directed).items()} and len(rows) == len({(r["seed"], r["id"]) for r in rows})
    assert all((r["parent"], r["id"]) in pairs or (not directed and (r["id"], r["parent"]) in pairs) for r in rows if r["distance"])


@pytest.mark.parametrize("directed", [True, False])
def test_shortest_paths(spark, made, directed):
    g, ids, pairs = made
    r = random.Random(2)
    asked = [(r.choice(ids), r.choice(ids)) for _ in range(40)] + [("p", "s"), ("x", "x"), ("p", "v1"), ("none", "v1"), ("none", "none"), (None, "v1")]
    rows = traverse.shortest_paths(g, spark.createDataFrame(asked + asked[:5], "src string, dst string"), directed=directed).collect()
    assert len(rows) == len({a for a in asked if a[0] is not None})
    for row in rows:
        assert row["distance"] == (reach(pairs, row["src"], directed).get(row["dst"]) if row["src"] in ids else None)
        if row["path"] is not None:
            assert (row["path"][0], row["path"][-1], len(row["path"])) == (row["src"], row["dst"], row["distance"] + 1)
            assert all((a, b) in pairs or (not directed and (b, a) in pairs) for a, b in zip(row["path"], row["path"][1:]))


def test_longest_path_and_stored_graph(spark, made):
    g, ids, pairs = made
    path = new_path(spark, "graph")
    graph_store.save_graph(g, path, hub_edges=5)
    stored = graph_store.open_graph(spark, path)
    asked = spark.createDataFrame([("hub", v) for v in ids], "src string, dst string")
    near = {r["dst"]: r["distance"] for r in traverse.shortest_paths(stored, asked, most=2).collect()}
    assert near == {v: d if (d := reach(pairs, "hub", True).get(v)) is not None and d <= 2 else None for v in ids}


def test_rank(made):
    g, ids, pairs = made
    m = np.zeros((len(ids), len(ids)))
    for a, b in pairs:
        m[ids.index(b), ids.index(a)] = 1
    loose = m.sum(axis=0) == 0
    m = np.where(loose, 1 / len(ids), m / np.where(loose, 1, m.sum(axis=0)))
    rank = np.full(len(ids), 1 / len(ids))
    for _ in range(200):
        rank = 0.15 / len(ids) + 0.85 * m @ rank
    got = {r["id"]: r["rank"] for r in traverse.rank(g, tolerance=1e-5).collect()}
    assert sorted(got) == ids and np.abs(np.array([got[v] for v in ids]) - rank).sum() < 1e-4 and abs(sum(got.values()) - 1) < 1e-9


def test_components(made):
    g, ids, pairs = made
    got = {r["id"]: r["component"] for r in traverse.components(g).collect()}
    assert got == {v: min(reach(pairs, v, False)) for v in ids}


def test_empty(spark):
    g = load(spark.createDataFrame([], "id string, label string, ord long"), spark.createDataFrame([], "src string, dst string, rel string, ord long"))
    none = spark.createDataFrame([], "seed string")
    assert traverse.distances(g, none).count() == 0 and traverse.rank(g).count() == 0 and traverse.components(g).count() == 0
    assert traverse.shortest_paths(g, spark.createDataFrame([("a", "b")], "src string, dst string")).first()["path"] is None
