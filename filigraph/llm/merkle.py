"""Merkle manifests of grouped documents, with a proof and a check for every row.

Ranks within a group come from a trie over the digits of ``doc_id``: histograms of the longest prefixes add up to those of shorter
ones, and offsets come back down from the root, each time over the few siblings of one trie node. No group is sorted as a whole.
The tree itself is a trie over the digits of the ranks: nodes that share the longest prefix meet in one block of bounded size and
become its root; the block roots are the nodes of the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigraph.llm.mixing import ranked
from filigraph.llm.shared import cut

#: Nodes that meet in one block, at most.
BLOCK = 1024
#: A trie node of more rows than this (an id that many rows have) is split by further digits.
HOT_ROWS = 65_536
#: An id has six digits, of 4 to 12 bits; the last one is left to the order within a node.
_ID_SHIFTS = (60, 48, 36, 24, 12)
_LEAF_DIGIT = 3  # hex digits of the leaf in one digit of the trie
#: The fields of a leaf, in the order of the leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    """A field as a leaf has it: `-` for null, else its UTF-8 length, a colon and its value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf of a row, with some fields replaced."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def tampered_leaf(every: int = 7) -> Column:
    """The leaf of a row after tampering: n_chars is one more where ``every`` divides the CRC of the id. Null ids and counts stay."""
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    more = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return F.when(hit & F.col("n_chars").isNotNull(), leaf(n_chars=more))


def _offsets(rows: DataFrame, prefixes: list[list[str]]) -> DataFrame:
    """(group, deepest prefix's columns, first, rows): how many rows of the group come before each trie node.

    ``prefixes`` are the columns of each level, the shortest first; each level has the columns that tell its nodes from those of other
    parents. Histograms add up from the deepest level, so rows are counted once.
    """
    levels = [rows.groupBy("group", *prefixes[-1]).agg(F.count(F.lit(1)).alias("rows"))]
    levels[0] = cut(levels[0], "histogram")
    for names in reversed(prefixes[:-1]):
        levels.insert(0, levels[0].groupBy("group", *names).agg(F.sum("rows").alias("rows")))
    known = None
    for depth, (table, names) in enumerate(zip(levels, prefixes)):
        parent = ["group", *(prefixes[depth - 1] if depth else [])]
        among = Window.partitionBy(*parent).orderBy(*[c for c in names if c not in parent]).rowsBetween(Window.unboundedPreceding, -1)
        table = table.withColumn("first", F.coalesce(F.sum("rows").over(among), F.lit(0)))
        if known is not None:
            table = table.join(known.select(*parent, F.col("first").alias("above")), parent).withColumn("first", F.col("first") + F.col("above")).drop("above")
        known = table
    return known


def group_ranks(leaves: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``leaves`` (group, doc_id, leaf, ...) with ``rank`` (from 0) and ``n`` within the group, by doc_id.

    Null ids come first; rows of one id come by the first 60 bits of their leaf, and rows that share those in any order. Ids are cut into
    digits by shifts; the nodes of the longest prefix hold 4096 ids at most. A node of more than ``hot_rows`` rows, so one
    with repeated ids, is split further by the digits of the leaves and by runs of rows.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = cut(leaves.withColumns({"id_order": order, "place": F.monotonically_increasing_id(), "is_set": F.col("doc_id").isNotNull()}), "merkle_leaves")
    ends = rows.agg(F.min("id_order").alias("low"), F.max("id_order").alias("high")).first()
    shifts = [s for s in _ID_SHIFTS if ends["low"] is not None and ends["low"] >> s != ends["high"] >> s] or [_ID_SHIFTS[-1]]  # digits that all ids share tell nothing
    prefixes = [f"p{s}" for s in shifts]
    rows = rows.withColumns({p: F.shiftright("id_order", s) for p, s in zip(prefixes, shifts)})
    nodes = cut(_offsets(rows, [prefixes[: i + 1] for i in range(len(prefixes))]).select("group", prefixes[-1], "first", "rows"), "merkle_offsets")
    totals = nodes.groupBy("group").agg(F.sum("rows").alias("n"))
    deep, order_in = prefixes[-1], ["id_order", "is_set", "leaf", "place"]

    def numbered(part: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
        within = F.row_number().over(Window.partitionBy("group", *names).orderBy(*order_in))
        return part.withColumn("within", within).join(table.select("group", *names, "first"), ["group", *names]).withColumn("rank", (F.col("first") + F.col("within") - 1).cast("long"))

    kept = [*leaves.columns, "rank"]
    hot = nodes.where(F.col("rows") > hot_rows).select("group", deep, F.col("first").alias("base"))
    if hot.isEmpty():
        out = numbered(rows, nodes, [deep]).select(kept)
    else:
        hot_keys = F.broadcast(hot)  # at most one node in hot_rows rows
        out = numbered(rows.join(hot_keys.select("group", deep), ["group", deep], "left_anti"), nodes, [deep]).select(kept)
        parts = {f"l{i}": F.substring("leaf", 1 + i * _LEAF_DIGIT, _LEAF_DIGIT) for i in range(5)} | {"run_36": F.shiftright("place", 36), "run_24": F.shiftright("place", 24), "run_12": F.shiftright("place", 12)}
        crowd = rows.join(hot_keys, ["group", deep]).withColumns(parts)
        crowd = crowd.withColumn("old_group", F.col("group")).withColumn("group", F.struct("group", deep, "base"))
        names = ["id_order", "is_set", *parts]
        ladder = [names[:i] for i in range(2, len(names) + 1)]
        again = numbered(crowd, _offsets(crowd, ladder), ladder[-1])
        again = again.withColumn("rank", (F.col("rank") + F.col("group.base")).cast("long")).drop("group").withColumnRenamed("old_group", "group")
        out = out.unionByName(again.select(kept))
    return out.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "group")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], n: int, fanout: int, height: int) -> list[list[str]]:
    """The levels of one block from its nodes upwards, up to ``height`` of them, as long as the whole group has several nodes there."""
    out = [nodes]
    while n > 1 and len(out) <= height:
        below = out[-1]
        out.append([_digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
        n = -(-n // fanout)
    return out


def _siblings(levels: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """What stands left and right of node ``i`` in its run, level by level."""
    out = []
    for nodes in levels[:-1]:
        start = i - i % fanout
        out.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fanout])))
        i //= fanout
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = _digest(left + leaf + right)
    return leaf


_PATH = "array<struct<left:string,right:string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _blocks(nodes: DataFrame, size: int, *carried: str) -> DataFrame:
    """(group, block, n, items): nodes (group, rank, n, hash, carried) by their rank's longest prefix, in order."""
    item = F.struct("rank", "hash", *carried)
    block = F.floor(F.col("rank") / F.lit(size)).cast("long")
    return nodes.groupBy("group", block.alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))


@dataclass
class Tree:
    """A tree of every group: ``rounds`` are its nodes at each block's foot, the leaves first; ``roots`` has (group, hash)."""

    rounds: list[DataFrame]
    roots: DataFrame
    fanout: int
    height: int


def build(nodes: DataFrame, fanout: int = 2, block: int = BLOCK) -> Tree:
    """The tree over nodes (group, rank, n, hash). A block has ``block`` nodes at most; a round is one aggregation."""
    height = max(1, next(h for h in range(64) if fanout ** (h + 1) > block))
    size = fanout**height

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_levels([x["hash"] for x in items], n, fanout, height)[-1][0] for items, n in zip(b.column("items").to_pylist(), b.column("n").to_pylist())]
            up = [max(1, -(-n // size)) for n in b.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("block"), pa.array(up, pa.int64()), pa.array(out, pa.string())], ["group", "rank", "n", "hash"])

    rounds = [nodes]
    while True:
        group_type = nodes.schema["group"].dataType.simpleString()
        above = _blocks(rounds[-1], size).mapInArrow(reduced, f"group {group_type}, rank long, n long, hash string")
        rounds.append(cut(above, "merkle_round"))
        if rounds[-1].where("n > 1").isEmpty():
            return Tree(rounds, rounds[-1].select("group", "hash"), fanout, height)


def _with_paths(tree: Tree, depth: int, upper: DataFrame, *carried: str) -> DataFrame:
    """Blocks of the nodes of a round, each with the path from its root upwards."""
    return _blocks(tree.rounds[depth], tree.fanout**tree.height, *carried).join(upper.select("group", F.col("rank").alias("block"), "path"), ["group", "block"])


def paths(tree: Tree, roots: DataFrame) -> DataFrame:
    """(group, rank, path) of the nodes above the leaves' blocks. ``roots`` has (group, path): what stands above a group's root."""
    fanout, height = tree.fanout, tree.height

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, items, n, path in zip(*[b.column(c) for c in ("group", "items", "n", "path")]):
                items, upper = items.as_py(), [(p["left"], p["right"]) for p in path.as_py()]
                levels = _levels([x["hash"] for x in items], n.as_py(), fanout, height)
                own = [[{"left": a, "right": z} for a, z in [*_siblings(levels, i, fanout), *upper]] for i in range(len(items))]
                yield pa.RecordBatch.from_arrays([pa.repeat(group, len(items)), pa.array([x["rank"] for x in items], pa.int64()), pa.array(own, _PATH_TYPE)], ["group", "rank", "path"])

    out = roots.select("group", F.lit(0).cast("long").alias("rank"), "path")
    kind = tree.roots.schema["group"].dataType.simpleString()
    for depth in range(len(tree.rounds) - 2, 0, -1):
        out = cut(_with_paths(tree, depth, out).mapInArrow(spread, f"group {kind}, rank long, path {_PATH}"), "merkle_paths")
    return out


def proofs(tree: Tree, upper: DataFrame) -> DataFrame:
    """(group, doc_id, leaf, proof_sha256, folded_root) of every leaf; ``shown`` is the leaf that is folded where it isn't null."""
    fanout, height = tree.fanout, tree.height

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, items, n, path in zip(*[b.column(c) for c in ("group", "items", "n", "path")]):
                items, above = items.as_py(), [(p["left"], p["right"]) for p in path.as_py()]
                levels = _levels([x["hash"] for x in items], n.as_py(), fanout, height)
                proof, root = [], []
                for i, x in enumerate(items):
                    own = [*_siblings(levels, i, fanout), *above]
                    proof.append(_digest("".join(a + z for a, z in own)))
                    root.append(fold(x["shown"] or x["hash"], own))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(group, len(items)), pa.array([x["doc_id"] for x in items], pa.int64()), pa.array([x["hash"] for x in items], pa.string()), pa.array(proof, pa.string()), pa.array(root, pa.string())],
                    ["group", "doc_id", "leaf", "proof_sha256", "folded_root"],
                )

    blocks = _with_paths(tree, 0, upper, "doc_id", "shown")
    return blocks.mapInArrow(proved, "group string, doc_id long, leaf string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, fanout: int = 2, tamper_every: int = 7, block: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per row of ``docs``.

    Leaves are digests of doc_id, source, lang, n_chars and text; every lang has a tree of its own, and their roots, by lang, a tree above them.
    ``folded_root`` is what a row's leaf gives with the untampered siblings, after tampering with the rows that :func:`tampered_leaf` names.
    Any column may be null. A null lang is the first group, a null id the first of its group. Rows of one id come by their leaves;
    equal rows have equal leaves and places of their own. An empty text is `0:`, not `-`. An empty table has no rows. Texts are read once and
    never shuffled; further columns aren't read.
    """
    group = F.coalesce(F.concat(F.lit("."), F.col("lang")), F.lit(""))  # null first, then bytewise
    fields = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in FIELDS[1:]])
    leaves = fields.select(group.alias("group"), "doc_id", leaf().alias("leaf"), tampered_leaf(tamper_every).alias("shown"))
    nodes = cut(group_ranks(leaves, hot_rows).withColumnRenamed("leaf", "hash"), "merkle_ranks")
    tree = build(nodes, fanout, block)
    groups = ranked(tree.roots.withColumnRenamed("hash", "subroot"), "group", "rank").withColumnRenamed("group", "name")
    count = groups.count()
    tops = cut(groups.select(F.lit(0).alias("group"), "rank", F.lit(count).cast("long").alias("n"), F.col("subroot").alias("hash"), "name"), "merkle_groups")
    top = build(tops, fanout, block)
    root = top.roots.first()
    upper = paths(top, top.roots.select("group", F.array().cast(_PATH).alias("path")))
    named = _top_paths(top, upper)
    out = proofs(tree, paths(tree, named.select(F.col("name").alias("group"), "path")))
    small = F.broadcast if count <= 100_000 else (lambda t: t)
    out = out.join(small(named.select(F.col("name").alias("group"), F.col("hash").alias("subroot"))), "group")
    out = out.withColumn("root", F.lit(root["hash"] if root else None).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _top_paths(top: Tree, upper: DataFrame) -> DataFrame:
    """(name, hash, path) of every group's root within the tree of the groups."""
    fanout, height = top.fanout, top.height

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for items, n, path in zip(*[b.column(c).to_pylist() for c in ("items", "n", "path")]):
                levels, above = _levels([x["hash"] for x in items], n, fanout, height), [(p["left"], p["right"]) for p in path]
                own = [[{"left": a, "right": z} for a, z in [*_siblings(levels, i, fanout), *above]] for i in range(len(items))]
                yield pa.RecordBatch.from_arrays([pa.array([x["name"] for x in items], pa.string()), pa.array([x["hash"] for x in items], pa.string()), pa.array(own, _PATH_TYPE)], ["name", "hash", "path"])

    return cut(_with_paths(top, 0, upper, "name").mapInArrow(spread, f"name string, hash string, path {_PATH}"), "merkle_tops")
