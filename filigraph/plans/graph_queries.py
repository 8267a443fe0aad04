"""Driver queries over stored graphs, and their SQL. Each stores the star graph in the work folder first, so that its whole work counts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from filigraph.operators import graph as graphs
from filigraph.operators.graph import Graph
from filigraph.plans.queries import GRAPH_CTE, NEIGHBOUR_SQL, PATHS_SQL, SEARCH_SQL, _seeds, _table, star_graph
from filigraph.sources import graph_store
from filigraph.work import new_path


def stored_star_graph(spark: SparkSession, sf_dir: str, hub_edges: int = 1000) -> Graph:
    """The star graph, stored and opened; order states with their many edges are hubs at the end where edges come in."""
    path = new_path(spark, "graph")
    graph_store.save_graph(star_graph(spark, sf_dir), path, hub_edges=hub_edges)
    return graph_store.open_graph(spark, path)


def stored_graph_search(spark, sf_dir):
    return graphs.search(stored_star_graph(spark, sf_dir), _seeds(spark, sf_dir, "an ia"), 10)


def stored_graph_paths(spark, sf_dir):
    return graphs.paths(stored_star_graph(spark, sf_dir, hub_edges=3), _seeds(spark, sf_dir))


def stored_graph_neighbours(spark, sf_dir):
    """The first lines of every node, found over the edges by both of their ends."""
    g = stored_star_graph(spark, sf_dir)
    return graphs.connections(g, 8, g.nodes.select("id"))


def stored_edges_by_name(spark, sf_dir):
    """The edges of the nations' names alone: the buckets of the names are read, not the graph."""
    names = [f"Nation:{r['n_nationkey']}" for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 names
    return graph_store.edges_of(stored_star_graph(spark, sf_dir, hub_edges=50), names).select("src", "dst", F.coalesce("rel", F.lit("")).alias("rel"), "ord")


BY_NAME_SQL = GRAPH_CTE + "SELECT src, dst, coalesce(rel, '') AS rel, ord FROM edges WHERE src IN (SELECT 'Nation:' || n_nationkey FROM nation)"

SPECS = {
    f.__name__: (f, sql)
    for f, sql in ((stored_graph_search, SEARCH_SQL), (stored_graph_paths, PATHS_SQL), (stored_graph_neighbours, NEIGHBOUR_SQL), (stored_edges_by_name, BY_NAME_SQL))
}
