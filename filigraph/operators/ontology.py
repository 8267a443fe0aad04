"""Checking a graph against a declared ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigraph.operators.graph import Graph


def violations(graph: Graph, ontology: DataFrame) -> DataFrame:
    """``src, dst, rel, fault`` of the edges that the ontology (``edge, domain, range``) doesn't allow.

    Faults: a relation that is not declared, an end that is no node, an end of another class. The ontology is a
    small catalogue; the optimiser decides by its size how to join it.
    """
    label = lambda p: graph.nodes.where("label is not null").select(F.col("id").alias(p), F.col("label").alias(f"{p}_label"))
    declared = ontology.groupBy(F.col("edge").alias("rel")).agg(F.collect_set("domain").alias("domains"), F.collect_set("range").alias("ranges"))
    joined = graph.edges.join(label("src"), "src", "left").join(label("dst"), "dst", "left").join(declared, "rel", "left")
    fault = (
        F.when(F.col("domains").isNull(), "undeclared relation")
        .when(F.col("src_label").isNull() | F.col("dst_label").isNull(), "dangling end")
        .when(~F.array_contains("domains", F.col("src_label")), "domain")
        .when(~F.array_contains("ranges", F.col("dst_label")), "range")
    )
    return joined.select("src", "dst", "rel", fault.alias("fault")).where("fault is not null")
