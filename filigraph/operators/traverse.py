"""Shortest paths, node rank and components of the property graph, by rounds over written tables.

A round follows the edges of what the round before found, by :meth:`filigraph.operators.graph.Graph.follow`, so over a stored graph only the frontier moves. Each
round is written to the shared folder: lineage doesn't grow and an executor that is lost costs one round. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigraph.operators.graph import Graph, members
from filigraph.work import cut, discard


def _step(graph: Graph, frontier: DataFrame, back: bool | None) -> DataFrame:
    """The frontier with ``next`` and ``ord``, along edges, against them, or (``back`` None) both."""
    sides = [graph.follow(frontier, "id", "next", back=b) for b in ((False, True) if back is None else (back,))]
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def _unseen(graph: Graph, frontier: DataFrame, seen: DataFrame, key: str, distance: int, back: bool | None) -> DataFrame:
    """``key, id, distance, parent`` of what a round reaches first. A vertex that many edges lead to is one row before it meets those seen: the parent is the smallest of its
    earliest edges' ends."""
    found = _step(graph, frontier.select(key, "id"), back).groupBy(key, F.col("next").alias("near")).agg(F.min(F.struct("ord", "id")).alias("first"))
    new = found.join(seen.select(key, F.col("id").alias("near")), [key, "near"], "left_anti")
    return new.select(key, F.col("near").alias("id"), F.lit(distance).alias("distance"), F.col("first.id").alias("parent"))


def distances(graph: Graph, seeds: DataFrame, most: int | None = None, directed: bool = True) -> DataFrame:
    """``seed, id, distance, parent``: every vertex that a seed reaches (in ``most`` edges), the seed itself with 0 and no parent.

    Repeated seeds count once; seeds outside the graph, and null ones, have no rows.
    """
    start = members(graph, seeds.select("seed").distinct()).select("seed", F.col("seed").alias("id"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"))
    levels = [cut(start, "level")]
    seen, k = levels[0], 0
    while most is None or k < most:
        k += 1
        new = cut(_unseen(graph, levels[-1], seen, "seed", k, None if not directed else False), "level")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new)
    return seen


def shortest_paths(graph: Graph, pairs: DataFrame, most: int = 16, directed: bool = True) -> DataFrame:
    """``src, dst, distance, path`` of pairs (src, dst), searched from both ends: distance and one shortest path as an array of ids, both null without a path of ``most`` edges.

    A round expands the side whose frontier is smaller, for the pairs that haven't met. Of several shortest paths, that over the smallest meeting vertex; towards both ends
    each vertex's parent has the earliest edge. Repeated pairs give one row; a pair of one vertex has distance 0 if it is a node; pairs with a null are none.
    """
    asked = cut(pairs.where("src is not null and dst is not null").select(F.struct("src", "dst").alias("pair")).distinct(), "pairs")
    node = graph.nodes.select(F.col("id").alias("__id"))

    def start(end: str) -> DataFrame:
        return cut(asked.select("pair", F.col(f"pair.{end}").alias("id"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")).join(node, F.col("id") == F.col("__id"), "left_semi"), "level")

    sides = {"src": start("src"), "dst": start("dst")}
    fronts, depth = dict(sides), {"src": 0, "dst": 0}
    met = graph.nodes.sparkSession.createDataFrame([], "pair struct<src:string,dst:string>, id string, distance int")

    def meetings(front: DataFrame, other: DataFrame) -> DataFrame:
        both = front.select("pair", "id", F.col("distance").alias("a")).join(other.select("pair", "id", F.col("distance").alias("b")), ["pair", "id"])
        return both.groupBy("pair").agg(F.min(F.struct((F.col("a") + F.col("b")).alias("distance"), "id")).alias("m")).select("pair", "m.id", "m.distance")

    # a pair is done when it first meets: rounds are one edge long, so the first meeting is a shortest one
    new = cut(meetings(fronts["src"], sides["dst"]), "met")
    while True:
        met = met.unionByName(new)
        if depth["src"] + depth["dst"] >= most:
            break
        open_ = {e: cut(f.join(new, "pair", "left_anti"), "front") for e, f in fronts.items()}
        counts = {e: f.count() for e, f in open_.items()}
        if not all(counts.values()):
            break  # a pair of which one side is exhausted has no path
        side = min(counts, key=lambda e: (counts[e], depth[e]))
        other = "dst" if side == "src" else "src"
        alive = open_[side].join(open_[other].select("pair").distinct(), "pair", "left_semi")
        depth[side] += 1
        back = None if not directed else side == "dst"
        level = cut(_unseen(graph, alive, sides[side], "pair", depth[side], back), "level")
        fronts = {side: level, other: open_[other]}
        sides[side] = sides[side].unionByName(level)
        new = cut(meetings(level, sides[other]), "met")
    walk = cut(met.select("pair", "distance", F.array("id").alias("path"), F.col("id").alias("first"), F.col("id").alias("last")), "walk")
    for end, column, join in (("src", "first", lambda p, path: F.concat(F.array(p), path)), ("dst", "last", lambda p, path: F.concat(path, F.array(p)))):
        for _ in range(depth[end]):
            parents = sides[end].where("parent is not null").select("pair", F.col("id").alias(column), "parent")
            joined = walk.join(parents, ["pair", column], "left")
            walk = cut(joined.withColumn("path", F.when(F.col("parent").isNull(), F.col("path")).otherwise(join(F.col("parent"), F.col("path")))).withColumn(column, F.coalesce("parent", column)).drop("parent"), "walk")
    out = asked.join(walk, "pair", "left")
    return out.select("pair.src", "pair.dst", "distance", "path")


def rank(graph: Graph, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, salts: int = 16) -> DataFrame:
    """``id, rank``: the share of a random walk's time at each node, one in all.

    A walk goes along one of the edges (repeated ones are one), with chance 1 - ``damping`` or from a node without edges to any node. Rounds end when all ranks together change by ``tolerance`` or less, or after
    ``rounds``. What enters a hub is summed where it is found and in ``salts`` shares before it meets.
    """
    ends = cut(graph.edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "rank_edges")
    degree = ends.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    nodes = cut(graph.nodes.select("id").distinct().join(degree.withColumnRenamed("src", "id"), "id", "left"), "rank_nodes")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    now = cut(nodes.withColumn("rank", F.lit(1.0 / n)), "rank")
    for _ in range(rounds):
        # one number: what lies at nodes without edges
        loose = now.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = ends.join(now.where("degree is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("part")), "src")
        shares = sent.groupBy("dst", F.pmod(F.xxhash64("src"), F.lit(salts)).alias("salt")).agg(F.sum("part").alias("part"))
        into = shares.groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("into"))
        new = (1 - damping) / n + damping * (F.coalesce("into", F.lit(0.0)) + loose / n)
        then = cut(now.join(into, "id", "left").select("id", "degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "rank")
        change = then.agg(F.sum("change")).first()[0]
        discard(now)
        now = then
        if change <= tolerance:
            break
    return now.select("id", "rank")


def components(graph: Graph) -> DataFrame:
    """``id, component``: the smallest id among all nodes that edges in any direction connect.

    Each round links what is larger than a vertex to its smallest neighbour, then what is smaller; stars are left after few rounds. The neighbours
    of a hub are never gathered: its smallest one is an aggregate, and the links are a join with it.
    """
    links = cut(graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "links")
    while True:
        # large star: each larger neighbour of a vertex to the smallest of its neighbourhood
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = cut(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct(), "links")
        # small star: each smaller neighbour, and the vertex itself, to the smallest one
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(smallest, "b").select("m", F.explode(F.array("a", "b")).alias("b")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        then = cut(small, "links")
        discard(large)
        same = then.count() == links.count() and then.join(links, ["a", "b"], "left_anti").isEmpty()
        discard(links)
        links = then
        if same:
            break
    named = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return graph.nodes.select("id").distinct().join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
