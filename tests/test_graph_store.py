"""Stored graphs: the same hops as loaded ones, no edge moved, hubs split, versions whole or not there."""

import pytest

from filigraph.operators import graph as graphs
from filigraph.sources import graph_store, versions
from filigraph.work import new_path

NODE, EDGE = "id string, label string, name string, text string, ord bigint", "src string, dst string, rel string, ord bigint"


def small(spark):
    """A hub with 60 edges out and one with 60 in, a name that looks like a hub's key, unknown ends, edges without a relation."""
    nodes = [("hub", "A", "Hub", None, 0), ("b", "B", None, "bee", 1), ("hub\x011", "C", "odd", "", 2), ("sink", None, "Sink", None, 3)]
    edges = [("hub", f"x{i}", "r", i) for i in range(60)] + [(f"x{i}", "sink", None if i % 2 else "s", 100 + i) for i in range(60)]
    edges += [("hub\x011", "b", "odd", 300), ("b", "hub", "back", 301), ("b", "hub", "again", 302), ("sink", "b", "t", 303)]
    return graphs.load(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def files_read(spark, df):
    """How many files a scan opens: each is made a partition of its own."""
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.set(k, "134217728")
        return df.select("src").rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def both(spark):
    g, path = small(spark), new_path(spark, "graph")
    version = graph_store.save_graph(g, path, buckets=4, hub_edges=7)
    return g, graph_store.open_graph(spark, path), path, version


def test_hops_are_those_of_the_loaded_graph(spark, both):
    g, stored, _, _ = both
    assert stored.hubs.count == 1 and stored.hubs_into.count == 1
    seeds = spark.createDataFrame([("hub",), ("hub\x011",), ("b",), ("nobody",)], "seed string")
    for operator in (graphs.one_hop, graphs.search, graphs.paths, graphs.overview, graphs.near_counts, graphs.distance_classes, lambda a, b: graphs.induced(a, b)[1]):
        assert rows_of(operator(stored, seeds)) == rows_of(operator(g, seeds))
    ids = seeds.withColumnRenamed("seed", "id")
    assert rows_of(graphs.connections(stored, 8, ids)) == rows_of(graphs.connections(g, 8, ids))
    assert rows_of(graphs.triplets(stored)) == rows_of(graphs.triplets(g))
    assert rows_of(graphs.label_counts(stored)) == rows_of(graphs.label_counts(g)) and rows_of(graphs.size(stored)) == rows_of(graphs.size(g))


def test_a_hub_lies_in_several_buckets(both):
    _, stored, _, _ = both
    keys = stored.edges.where("src = 'hub'").groupBy("key").count().collect()
    assert len(keys) == 9 and max(r["count"] for r in keys) <= 20


def test_edges_do_not_move(spark, tmp_path):
    """Without broadcasts the seeds are shuffled to the buckets, and no exchange lies above an edge table."""
    g, path = small(spark), new_path(spark, "graph")
    graph_store.save_graph(g, path, buckets=4)
    stored = graph_store.open_graph(spark, path)
    assert stored.hubs.count == 0
    seeds = spark.createDataFrame([("hub",), ("b",)], "seed string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = graphs.next_hop(stored, graphs.one_hop(stored, seeds), 2, ("seed",))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = plan.splitlines()
    depth = lambda x: max(x.find("+- "), x.find(":- "))
    scans = [i for i, x in enumerate(lines) if "Scan parquet" in x]
    assert len(scans) == 2 and plan.count("Exchange hashpartitioning") == 2
    for at in scans:
        above, level = [], depth(lines[at])
        for x in reversed(lines[:at]):
            if depth(x) < level:
                level = depth(x)
                above.append(x)
                if "Join" in x:
                    break
        assert above and not any("Exchange" in x for x in above), above
        assert "Bucketed: true" in lines[at]


def test_names_read_their_buckets_only(spark, both):
    _, stored, _, _ = both
    found = graph_store.edges_of(stored, ["b", "hub\x011"])
    assert rows_of(found) == sorted([("hub", 301, "again", "b"), ("b", 300, "odd", "hub\x011")], key=repr)
    assert files_read(spark, graph_store.edges_of(stored, ["b"])) == 1 and files_read(spark, stored.edges) == 4
    assert graph_store.edges_of(stored, ["hub"]).count() == 60 and graph_store.edges_of(stored, []).count() == 0
    with pytest.raises(ValueError):
        graph_store.edges_of(stored, ["x"] * 1001)


def test_versions(spark, both):
    g, _, path, version = both
    shorter = graphs.Graph(g.nodes, g.edges.where("src = 'b'"))
    second = graph_store.save_graph(shorter, path, buckets=2)
    assert versions.published(spark, path) == [version, second] and graph_store.open_graph(spark, path).edges.count() == 1
    assert graph_store.open_graph(spark, path, version).edges.count() == g.edges.count()
    graph_store.forget(spark, path, second)  # what another application sees: files alone
    again = graph_store.open_graph(spark, path, second)
    assert again.edges.count() == 1 and graph_store.edges_of(again, ["b"]).count() == 1
    with pytest.raises(FileExistsError):
        versions.publish(spark, path, second, {})
    with pytest.raises(FileNotFoundError):
        graph_store.open_graph(spark, path, 99)
    with pytest.raises(FileNotFoundError):
        graph_store.open_graph(spark, new_path(spark, "none"))


def test_an_unfinished_version_is_not_seen_and_old_ones_go(spark):
    path = new_path(spark, "graph")
    assert versions.published(spark, path) == []
    for n in (1, 2, 3):
        versions.publish(spark, path, n, {"n": n})
    spark.range(1).write.parquet(f"{path}/v4/out")  # a writer that died
    assert versions.describe(spark, path) == (3, {"n": 3}) and versions.next_version(spark, path) == 4
    assert versions.expire(spark, path, keep=1) == [1, 2] and versions.published(spark, path) == [3]


def test_empty_graph(spark):
    path = new_path(spark, "graph")
    graph_store.save_graph(graphs.load(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)), path)
    stored = graph_store.open_graph(spark, path)
    assert stored.nodes.count() == 0 and graphs.one_hop(stored, spark.createDataFrame([("a",)], "seed string")).count() == 0
