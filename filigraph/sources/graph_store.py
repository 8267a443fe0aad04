"""Graphs as stored tables that hops join without moving an edge.

A version of a graph has four tables: nodes bucketed by id, edges bucketed and sorted by where they start, the same edges by where they end,
and the hubs. The edges of a hub would all lie in one bucket, so a vertex with very many edges has several keys, each with a share of
them, and the hubs table tells how many; whoever follows edges from a hub asks for all of its keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigraph.operators.graph import ATTRIBUTES, Graph, Hubs, edge_key
from filigraph.sources import versions
from filigraph.work import cut, discard

_NODES = ", ".join(["id string", *[f"{c} string" for c in ATTRIBUTES], "ord bigint"])
_EDGES = "key string, src string, dst string, rel string, ord bigint"
_HUBS = "id string, parts int"


def _name(path: str, version: int, table: str) -> str:
    """The name of a version's table in the session's catalog."""
    return f"filigraph_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{version}_{table}"


def _hubs(edges: DataFrame, end: str, most: int) -> DataFrame:
    """(id, parts) of the vertices with more than ``most`` edges at ``end``."""
    n = F.count(F.lit(1))
    return edges.groupBy(F.col(end).alias("id")).agg(n.alias("n")).where(F.col("n") > most).select("id", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def _write(table: DataFrame, path: str, version: int, what: str, key: str, buckets: int, *order: str) -> None:
    dealt = table.repartition(buckets, key)  # one task a bucket, so one file a bucket
    where = f"{path}/v{version}/{what}"
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", where).mode("errorifexists").saveAsTable(_name(path, version, what))


def save_graph(graph: Graph, path: str, buckets: int | None = None, hub_edges: int = 100_000, edges_a_bucket: int = 1_000_000) -> int:
    """Writes a loaded graph below ``path`` and returns its version, which is visible once all tables are.

    Without ``buckets`` there is one for each ``edges_a_bucket`` edges, four at least. A vertex with more than ``hub_edges`` edges at one end has several
    keys there. Missing attributes become null columns.
    """
    spark = graph.nodes.sparkSession
    version = versions.next_version(spark, path)
    edges = cut(graph.edges.select("src", "dst", "rel", F.col("ord").cast("bigint").alias("ord")), "graph_edges")
    count = edges.count()
    buckets = buckets or max(4, -(-count // edges_a_bucket))
    about = {"buckets": buckets, "edges": count}
    for what, end, other in (("out", "src", "dst"), ("into", "dst", "src")):
        hubs = _hubs(edges, end, hub_edges)
        hubs.write.parquet(f"{path}/v{version}/hubs_{what}")
        hubs = spark.read.schema(_HUBS).parquet(f"{path}/v{version}/hubs_{what}")
        about[f"hubs_{what}"] = hubs.count()
        rows = edges
        if about[f"hubs_{what}"]:
            parts = Hubs(hubs, about[f"hubs_{what}"]).table().withColumnRenamed("id", end)
            rows = edges.join(parts, end, "left").withColumn("key", edge_key(F.col(end), F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")))
        else:
            rows = edges.withColumn("key", F.col(end))
        _write(rows.select("key", "src", "dst", "rel", "ord"), path, version, what, "key", buckets, "ord")
    given = [F.col(c) if c in graph.nodes.columns else F.lit(None).cast("string").alias(c) for c in ATTRIBUTES]
    _write(graph.nodes.select("id", *given, F.col("ord").cast("bigint").alias("ord")), path, version, "nodes", "id", buckets)
    versions.publish(spark, path, version, about)
    discard(edges)
    return version


def open_graph(spark: SparkSession, path: str, version: int | None = None) -> Graph:
    """A stored graph, its newest version without a number. A version never changes, so an open graph isn't touched by later ones."""
    version, about = versions.describe(spark, path, version)

    def table(what: str, key: str, schema: str) -> DataFrame:
        name, where = _name(path, version, what), f"{path}/v{version}/{what}".replace("'", "\\'")
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {about['buckets']} BUCKETS LOCATION '{where}'")
        return spark.table(name)

    hubs = {what: Hubs(spark.read.schema(_HUBS).parquet(f"{path}/v{version}/hubs_{what}"), about[f"hubs_{what}"]) for what in ("out", "into")}
    return Graph(table("nodes", "id", _NODES), table("out", "key", _EDGES), into=table("into", "key", _EDGES), hubs=hubs["out"], hubs_into=hubs["into"])


def forget(spark: SparkSession, path: str, version: int) -> None:
    """Takes a version's tables out of the session's catalog; the files stay."""
    for what in ("nodes", "out", "into"):
        spark.sql(f"DROP TABLE IF EXISTS {_name(path, version, what)}")


def edges_of(graph: Graph, ids: list[str], most: int = 1000) -> DataFrame:
    """``src, dst, rel, ord`` of the edges that leave a few vertices of a stored graph, by name: only their buckets are read, and of these only the pages that can have them.

    More than ``most`` names are for :func:`filigraph.operators.graph.one_hop`, and raise a ValueError.
    """
    if len(ids) > most:
        raise ValueError(f"more than {most} names; make a table of them and follow their edges")
    keys = set(ids)
    if graph.hubs is not None and graph.hubs.count:
        for r in graph.hubs.rows.where(F.col("id").isin(ids)).collect():  # as many rows as names at most
            keys |= {_literal_key(r["id"], p) for p in range(r["parts"])}
    return graph.edges.where(F.col("key").isin(sorted(keys)) & F.col("src").isin(ids)).select("src", "dst", "rel", "ord")


def _literal_key(vertex: str, part: int) -> str:
    return vertex if part == 0 else f"{vertex}\x01{part}"
