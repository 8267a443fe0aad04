"""Property-graph operators over a node and an edge table, for any number of seeds at once.

Every result carries the order of the edges it came by, so ties are broken as a walk through
the insertion order would. Seeds are a table with a ``seed`` column of node ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigraph.functions.text import capability_name, clip, display, filled_or_empty, first_filled, risk_name
from filigraph.work import cut

ATTRIBUTES = ("label", "ticker", "cik", "name", "text", "objective_type", "status", "risk_category")


#: Hubs of up to so many vertices are broadcast.
FEW_HUBS = 500_000


@dataclass
class Hubs:
    """``rows`` (id, parts): the vertices whose edges lie under several keys; ``count`` of them."""

    rows: DataFrame
    count: int

    def table(self) -> DataFrame:
        return F.broadcast(self.rows) if self.count <= FEW_HUBS else self.rows


def edge_key(vertex: Column, part: Column) -> Column:
    """The key of a share of a vertex's edges; the first share's is the vertex itself."""
    return F.when(part == 0, vertex).otherwise(F.concat(vertex, F.lit("\x01"), part.cast("string")))


@dataclass
class Graph:
    """``nodes`` (id, attributes, ord) with one row an id; ``edges`` (src, dst, rel, ord) with one row a pair.

    A stored graph also has its edges by their ends (``into``), keys of shares of the edges, and the hubs, whose edges have several keys.
    """

    nodes: DataFrame
    edges: DataFrame
    into: DataFrame | None = None
    hubs: Hubs | None = None
    hubs_into: Hubs | None = None

    def cache(self) -> Graph:
        return Graph(self.nodes.cache(), self.edges.cache())

    def follow(self, rows: DataFrame, column: str, other: str, rel: str = "rel", ord: str = "ord", back: bool = False) -> DataFrame:
        """``rows`` with each edge that leaves (``back``: enters) the vertex in ``column``: its other end, relation and place.

        Over stored edges only ``rows`` move: to the buckets of their vertices' keys.
        """
        end, far = ("dst", "src") if back else ("src", "dst")
        found = [F.col(far).alias(other), F.col("rel").alias(rel), F.col("ord").alias(ord)]
        hubs = self.hubs_into if back else self.hubs
        if hubs is None:
            return rows.join(self.edges.select(F.col(end).alias(column), *found), column)
        edges = self.into if back else self.edges
        if not hubs.count:
            return rows.join(edges.select(F.col("key").alias(column), *found), column)
        parts = rows.join(hubs.table().select(F.col("id").alias(column), "parts"), column, "left")
        keyed = parts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumn("__key", edge_key(F.col(column), F.col("__part"))).drop("parts", "__part")
        same = F.col("__end") == F.col(column)  # a name may look like another one's key
        return keyed.join(edges.select(F.col("key").alias("__key"), F.col(end).alias("__end"), *found), "__key").where(same).drop("__key", "__end")


def load(nodes: DataFrame, edges: DataFrame, write: bool = False) -> Graph:
    """A graph with the semantics of insertion: a repeated node merges attributes (the last filled one wins), a
    repeated edge keeps its first place and its last relation, and unknown ends become nodes without attributes.

    With ``write`` both tables are written to the work folder, so that operators which read them several times load them once.
    """
    present = [c for c in ATTRIBUTES if c in nodes.columns]
    last = [F.max_by(c, F.when(F.col(c).isNotNull() & (F.trim(F.col(c)) != ""), F.col("ord"))).alias(c) for c in present]
    merged = nodes.groupBy("id").agg(F.min("ord").alias("ord"), *last)
    links = edges.groupBy("src", "dst").agg(F.max_by("rel", "ord").alias("rel"), F.min("ord").alias("ord"))
    links = cut(links, "edges") if write else links
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(merged, "id", "left_anti")
    everything = merged.unionByName(ends, allowMissingColumns=True)
    return Graph(cut(everything, "nodes") if write else everything, links)


def _text() -> Column:
    return filled_or_empty(F.col("text"), F.col("name"))


def _described(graph: Graph, prefix: str) -> DataFrame:
    """Ids, labels (empty without one) and texts for joins."""
    return graph.nodes.select(F.col("id").alias(f"{prefix}"), F.coalesce("label", F.lit("")).alias(f"{prefix}_label"), _text().alias(f"{prefix}_text"))


def members(graph: Graph, seeds: DataFrame) -> DataFrame:
    """The seeds that are nodes."""
    return seeds.join(graph.nodes, F.col("seed") == graph.nodes["id"], "left_semi")


def one_hop(graph: Graph, seeds: DataFrame, unnamed: str | None = "") -> DataFrame:
    """``seed, n1, e1, o1`` (other columns of the seeds stay); ``unnamed`` stands for a missing relation."""
    return graph.follow(seeds, "seed", "n1", "e1", "o1").withColumn("e1", F.coalesce("e1", F.lit(unnamed)))


def next_hop(graph: Graph, paths: DataFrame, k: int, not_back_to: tuple[str, ...], unnamed: str | None = "") -> DataFrame:
    """Paths one edge longer: adds ``n{k}, e{k}, o{k}``, never back to the given vertices."""
    out = graph.follow(paths, f"n{k - 1}", f"n{k}", f"e{k}", f"o{k}").withColumn(f"e{k}", F.coalesce(f"e{k}", F.lit(unnamed)))
    for column in not_back_to:
        out = out.where(F.col(f"n{k}") != F.col(column))
    return out


def relevance(text: Column, topic: Column) -> Column:
    """0.9 if the text has the whole topic, 0.7 if it has one of its words, else 0.5; an empty topic says nothing."""
    low, want = F.lower(text), F.lower(F.coalesce(topic, F.lit("")))
    some = F.exists(F.filter(F.split(want, r"(?U)\s+"), lambda w: w != ""), lambda w: F.contains(low, w))
    return F.when(want == "", 0.5).when(F.contains(low, want), 0.9).when(some, 0.7).otherwise(0.5)


def search(graph: Graph, seeds: DataFrame, top_k: int = 10) -> DataFrame:
    """The ``top_k`` hits of each seed: neighbours scored against ``topic`` (if the seeds have it) and all two-hop ends.

    ``seed, place, node_id, label, text, relation, score, path``; ties keep the order of the walk. Two-hop ends score below
    every neighbour, so only seeds with fewer than ``top_k`` neighbours are expanded a second time.
    """
    seeds = seeds if "topic" in seeds.columns else seeds.withColumn("topic", F.lit(None).cast("string"))
    first = one_hop(graph, seeds, None).join(_described(graph, "n1"), "n1")
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown")).alias("label")
    near = first.select(
        "seed", F.lit(1).alias("branch"), "o1", F.lit(None).cast("bigint").alias("o2"), F.col("n1").alias("node_id"), named("n1_label"),
        F.col("n1_text").alias("text"), F.coalesce("e1", F.lit("")).alias("relation"), relevance(F.col("n1_text"), F.col("topic")).alias("score"), F.lit(None).cast("string").alias("path"),
    )
    few = first.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < top_k).select("seed")
    second = next_hop(graph, first.join(few, "seed", "left_semi"), 2, ("seed",), None).join(_described(graph, "n2"), "n2")
    e1, e2 = (F.coalesce(e, F.lit("?")) for e in ("e1", "e2"))
    arrow = lambda e, n: F.concat(F.lit(" →["), e, F.lit("]→ "), F.col(n))
    far = second.select(
        "seed", F.lit(2).alias("branch"), "o1", "o2", F.col("n2").alias("node_id"), named("n2_label"), F.col("n2_text").alias("text"),
        F.concat_ws(" → ", e1, e2).alias("relation"), F.lit(0.4).alias("score"), F.concat(F.col("seed"), arrow(e1, "n1_label"), arrow(e2, "n2_label")).alias("path"),
    )
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "branch", "o1", "o2", "node_id")
    ranked = near.unionByName(far).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
    return ranked.select("seed", "place", "node_id", "label", "text", "relation", "score", "path")


def paths(graph: Graph, seeds: DataFrame) -> DataFrame:
    """All paths of one to three edges: ``seed, o1, o2, o3, path, description, weight``, in pre-order by (o1, o2, o3)."""
    first = one_hop(graph, seeds).join(_described(graph, "n1"), "n1")
    second = next_hop(graph, first, 2, ("seed",)).join(_described(graph, "n2").drop("n2_text"), "n2")
    third = next_hop(graph, second, 3, ("seed", "n1")).join(_described(graph, "n3").drop("n3_text"), "n3")
    gap = F.lit(None).cast("bigint")
    out = first.select("seed", "o1", gap.alias("o2"), gap.alias("o3"), F.concat("seed", F.lit(" →["), "e1", F.lit("]→ "), "n1_label").alias("path"), F.col("n1_text").alias("description"))
    out = out.unionByName(second.select("seed", "o1", "o2", gap.alias("o3"), F.concat_ws(" → ", "seed", "n1_label", "n2_label").alias("path"), F.concat_ws(" → ", "e1", "e2").alias("description")))
    out = out.unionByName(third.select("seed", "o1", "o2", "o3", F.concat_ws(" → ", "seed", "n1_label", "n2_label", "n3_label").alias("path"), F.concat_ws(" → ", "e1", "e2", "e3").alias("description")))
    return out.withColumn("weight", F.lit(1.0))


def overview(graph: Graph, seeds: DataFrame, lists: dict[str, str] | None = None, single: str = "Mission") -> DataFrame:
    """One row per seed: its name, the last text of label ``single``, a list of texts for each label, and sizes.

    ``lists`` maps output columns to labels. ``nodes`` counts distinct vertices within two hops and the seed,
    ``edges`` the paths of one and two edges. A seed outside the graph gets empty values and zeros.
    """
    lists = lists or {"objectives": "StrategicObjective", "capabilities": "Capability", "initiatives": "Initiative", "risks": "RiskTheme"}
    first = one_hop(graph, seeds).join(_described(graph, "n1"), "n1")
    texts = lambda label: F.transform(F.sort_array(F.collect_list(F.when(F.col("n1_label") == label, F.struct("o1", "n1_text")))), lambda x: x["n1_text"])
    parts = first.groupBy("seed").agg(
        F.max_by("n1_text", F.when(F.col("n1_label") == single, F.col("o1"))).alias("mission"), *[texts(label).alias(c) for c, label in lists.items()], F.count(F.lit(1)).alias("near")
    )
    hops = one_hop(graph, seeds.select("seed"))
    reach = next_hop(graph, hops, 2, ("seed",)).select("seed", F.col("n2").alias("n"), F.lit(1).alias("far")).unionByName(hops.select("seed", F.col("n1").alias("n"), F.lit(0).alias("far")))
    # by vertex first, so that a hub's paths are counted where they are found
    ends = reach.groupBy("seed", "n").agg(F.sum("far").alias("far"))
    sizes = ends.groupBy("seed").agg(F.count_if(F.col("n") != F.col("seed")).alias("others"), F.sum("far").alias("far"))
    names = graph.nodes.select(F.col("id").alias("seed"), F.coalesce(F.col("name"), F.substring_index("id", ":", -1)).alias("name"))
    empty = F.array().cast("array<string>")
    joined = seeds.select("seed").join(names, "seed", "left").join(parts, "seed", "left").join(sizes, "seed", "left")
    known = F.col("name").isNotNull()
    return joined.select(
        F.substring_index("seed", ":", -1).alias("ticker"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("mission", F.lit("")).alias("mission"),
        *[F.coalesce(F.col(c), empty).alias(c) for c in lists],
        F.when(known, F.coalesce("others", F.lit(0)) + 1).otherwise(0).alias("nodes"), (F.coalesce("near", F.lit(0)) + F.coalesce("far", F.lit(0))).alias("edges"),
    )


def profile_view(graph: Graph, seeds: DataFrame, companies: DataFrame, risk_names: dict[str, str] | None = None) -> DataFrame:
    """What an overview page shows of each seed: its size within one hop, the curated mission of ``companies`` (ticker, ...) or else the extracted one, and lists of texts for display.

    ``ticker, name, fiscal_year, alignment_label, alignment_rationale, nodes, edges, mission, objectives, capabilities, initiatives, risks``. A seed outside the graph has one node, itself.
    """
    shown = {"StrategicObjective": ("objectives", display), "Capability": ("capabilities", capability_name), "Initiative": ("initiatives", display), "RiskTheme": ("risks", lambda c: risk_name(c, risk_names))}
    first = one_hop(graph, seeds.select("seed")).join(_described(graph, "n1"), "n1")
    item = F.coalesce(*[F.when(F.col("n1_label") == label, f(F.col("n1_text"))) for label, (_, f) in shown.items()], F.col("n1_text"))
    texts = lambda label: F.transform(F.sort_array(F.collect_list(F.when(F.col("n1_label") == label, F.struct("o1", "n1", "item")))), lambda x: x["item"])
    parts = first.withColumn("item", item).groupBy("seed").agg(
        F.count(F.lit(1)).alias("edges"), F.max_by("n1_text", F.when(F.col("n1_label") == "Mission", F.col("o1"))).alias("extracted"), *[texts(label).alias(c) for label, (c, _) in shown.items()]
    )
    known = companies.select(F.col("ticker").alias("__ticker"), *[F.col(c) if c in companies.columns else F.lit(None).cast("string").alias(c) for c in ("name", "fiscal_year", "mission", "alignment_label", "alignment_rationale")])
    ticker = F.substring_index("seed", ":", -1)
    rows = seeds.select("seed", ticker.alias("ticker")).join(known, F.col("ticker") == F.col("__ticker"), "left").join(parts, "seed", "left")
    empty = F.array().cast("array<string>")
    return rows.select(
        "ticker", F.coalesce("name", "ticker").alias("name"), "fiscal_year", "alignment_label", "alignment_rationale", (F.coalesce("edges", F.lit(0)) + 1).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"),
        filled_or_empty(F.col("mission"), F.col("extracted")).alias("mission"), *[F.coalesce(F.col(c), empty).alias(c) for c, _ in shown.values()],
    )


def compare(graph: Graph, seed1: str, seed2: str, **options) -> DataFrame:
    """One row: the overviews of two seeds as ``company1`` and ``company2``, and the compared dimensions."""
    spark = graph.nodes.sparkSession
    both = overview(graph, spark.createDataFrame([(seed1,), (seed2,)], "seed string"), **options)
    side = lambda seed, name: both.where(F.col("ticker") == seed.rpartition(":")[2]).select(F.struct("*").alias(name)).limit(1)
    dims = F.array(*[F.lit(x) for x in ("Mission", "Strategic Objectives", "Capabilities", "Initiatives", "Risk Themes")])
    return side(seed1, "company1").crossJoin(side(seed2, "company2")).withColumn("dimensions", dims)  # one row each


def near_counts(graph: Graph, seeds: DataFrame) -> DataFrame:
    """``seed, nodes, edges`` within one hop, the seed included."""
    counts = one_hop(graph, members(graph, seeds)).groupBy("seed").agg(F.count(F.lit(1)).alias("edges"))
    out = seeds.select("seed").join(counts, "seed", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return out.select("seed", (F.col("edges") + 1).alias("nodes"), "edges")


def induced(graph: Graph, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``seed, id``), (``seed, src, dst, rel, ord``): vertices within two hops, and all edges with both ends among them."""
    first = one_hop(graph, members(graph, seeds).select("seed"))
    second = next_hop(graph, first, 2, ())
    inside = (
        members(graph, seeds).select("seed", F.col("seed").alias("id"))
        .unionByName(first.select("seed", F.col("n1").alias("id")))
        .unionByName(second.select("seed", F.col("n2").alias("id"))).distinct()
    )
    out = graph.follow(inside.withColumnRenamed("id", "src"), "src", "dst")
    return inside, out.join(inside.withColumnRenamed("id", "dst"), ["seed", "dst"], "left_semi").select("seed", "src", "dst", "rel", "ord")


def connections(graph: Graph, most: int = 8, ids: DataFrame | None = None) -> DataFrame:
    """``id, place, line``: up to ``most`` lines for each node (or each of ``ids``) over the whole graph, edges in before edges out.

    The first lines are found in a window that keeps few rows per node, so hubs cost no more memory.
    """
    label = graph.nodes.select(F.col("id").alias("other"), F.coalesce("label", F.lit("")).alias("other_label"))
    if ids is None:
        into = graph.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "rel", "ord")
        out_of = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel", "ord")
    else:
        wanted = ids.select("id").distinct()
        into, out_of = graph.follow(wanted, "id", "other", back=True), graph.follow(wanted, "id", "other")
    place = F.row_number().over(Window.partitionBy("id").orderBy("side", "ord", "other"))
    sides = into.withColumn("side", F.lit(0)).unionByName(out_of.withColumn("side", F.lit(1)))
    top = sides.withColumn("place", place).where(F.col("place") <= most).join(label, "other", "left")
    kind, rel = F.coalesce("other_label", F.lit("")), F.coalesce("rel", F.lit("?"))
    line = F.when(F.col("side") == 0, F.concat(F.lit("  IN:  ["), kind, F.lit("] --"), rel, F.lit("--> this"))).otherwise(
        F.concat(F.lit("  OUT: this --"), rel, F.lit("--> ["), kind, F.lit("]"))
    )
    return top.select("id", "place", line.alias("line"))


def _shown(prefix: str, risk_names: dict[str, str] | None) -> Column:
    raw = F.coalesce(first_filled(F.col(f"{prefix}_text")), F.col(prefix))
    label = F.col(f"{prefix}_label")
    return display(F.when(label == "RiskTheme", risk_name(raw, risk_names)).when(label == "Capability", capability_name(raw)).otherwise(raw))


def triplets(graph: Graph, edges: DataFrame | None = None, size: int = 80, risk_names: dict[str, str] | None = None) -> DataFrame:
    """``subject_type, subject, predicate, object_type, object`` of edges, displayed and cut to ``size``.

    Size 60 gives the plain listing that stands in for a drawing.
    """
    rows = edges if edges is not None else graph.edges
    side = lambda p: graph.nodes.select(F.col("id").alias(p), F.coalesce("label", F.lit("")).alias(f"{p}_label"), _text().alias(f"{p}_text"))
    joined = rows.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    kept = [c for c in ("seed",) if c in rows.columns]
    return joined.select(
        *kept, "ord", F.coalesce("src_label", F.lit("")).alias("subject_type"), F.substring(_shown("src", risk_names), 1, size).alias("subject"), F.coalesce("rel", F.lit("")).alias("predicate"),
        F.coalesce("dst_label", F.lit("")).alias("object_type"), F.substring(_shown("dst", risk_names), 1, size).alias("object"),
    )


def node_view(graph: Graph, ids: DataFrame, colors: dict[str, str], sizes: dict[str, int], default_color: str = "#95a5a6", default_size: int = 22, risk_names: dict[str, str] | None = None) -> DataFrame:
    """What a drawing shows of nodes: ``id, display`` (45 characters), ``color, size, tooltip`` with its connections."""
    lookup = lambda table, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("label")), F.lit(default))
    lines = connections(graph, ids=ids).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    rows = ids.select("id").distinct().join(graph.nodes, "id").join(lines, "id", "left").withColumn("label", F.coalesce("label", F.lit("Unknown")))
    raw = F.coalesce(first_filled(F.col("text"), F.col("name")), F.substring_index("id", ":", -1))
    named = F.when(F.col("label") == "RiskTheme", risk_name(raw, risk_names)).when(F.col("label") == "Capability", capability_name(raw)).otherwise(display(raw))
    full = F.when(F.col("label") == "RiskTheme", risk_name(_text(), risk_names)).otherwise(display(_text()))
    tooltip = F.concat_ws("\n", F.concat(F.lit("["), "label", F.lit("]")), F.concat(F.lit("Text: "), F.substring(full, 1, 250)), F.lit(""), F.lit("Connections:"), F.col("lines"))
    return rows.select("id", clip(named, 45).alias("display"), lookup(colors, default_color).alias("color"), lookup(sizes, default_size).alias("size"), tooltip.alias("tooltip"))


def edge_view(graph: Graph, edges: DataFrame | None = None, risk_names: dict[str, str] | None = None) -> DataFrame:
    """What a drawing shows of edges: ``subject_type, ..., tooltip`` with both texts cut to 120 characters."""
    rows = triplets(graph, edges, 120, risk_names)
    return rows.withColumn("tooltip", F.format_string("TRIPLE\nSubject:   [%s] %s\nPredicate: %s\nObject:    [%s] %s", "subject_type", "subject", "predicate", "object_type", "object"))


def label_counts(graph: Graph, ids: DataFrame | None = None) -> DataFrame:
    """``label, n`` of all nodes or of those with the given ids, by label."""
    rows = graph.nodes if ids is None else graph.nodes.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.groupBy(F.coalesce("label", F.lit("Other")).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label")


def relation_counts(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    rows = graph.edges if edges is None else edges
    return rows.groupBy(F.coalesce("rel", F.lit("unknown")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def size(graph: Graph) -> DataFrame:
    """One row: ``nodes, edges``."""
    return graph.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def distance_classes(graph: Graph, seeds: DataFrame) -> DataFrame:
    """``seed, id, distance`` (0, 1 or 2) along edges in either direction; farther nodes are not listed."""
    def around(rows: DataFrame, distance: int) -> DataFrame:
        near = graph.follow(rows.select("seed", "id"), "id", "next").unionByName(graph.follow(rows.select("seed", "id"), "id", "next", back=True))
        return near.select("seed", F.col("next").alias("id"), F.lit(distance).alias("distance")).distinct()

    start = members(graph, seeds).select("seed", F.col("seed").alias("id"), F.lit(0).alias("distance"))
    first = around(start, 1)
    second = around(first, 2)
    return start.unionByName(first).unionByName(second).groupBy("seed", "id").agg(F.min("distance").alias("distance"))


def select_nodes(graph: Graph, ids: DataFrame) -> DataFrame:
    """``id, shown``: all nodes, those with the given ids shown. No ids show all (a reset)."""
    if ids.isEmpty():
        return graph.nodes.select("id", F.lit(True).alias("shown"))
    marked = ids.select("id").distinct().withColumn("shown", F.lit(True))
    return graph.nodes.select("id").join(marked, "id", "left").select("id", F.coalesce("shown", F.lit(False)).alias("shown"))


def filter_by_property(graph: Graph, of: str, property: str, values: list) -> DataFrame:
    """``id`` of the nodes with such a value, or (``of`` = "edge") of both ends of such edges."""
    if of == "node":
        return graph.nodes.where(F.col(property).isin(values)).select("id")
    return graph.edges.where(F.col(property).isin(values)).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
