"""Merkle manifests against a plain version: one list a level, one loop a leaf."""

import hashlib
import zlib

import pytest

from filigraph.llm import merkle, queries
from tests.oracle import assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    shown = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)]
    return digest("".join(shown))


def plain_tree(nodes, fanout):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_path(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // fanout * fanout :][:fanout]
        out.append((run[: i % fanout], run[i % fanout + 1 :]))
        i //= fanout
    return out


def plain(rows, fanout=2, every=7):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names], fanout) if names else [[None]]
    out = []
    for place, g in enumerate(names):
        for i, (_, _, leaf, (doc_id, text, lang, source, n)) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = plain_path(trees[g], i, fanout) + plain_path(top, place, fanout)
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % every == 0 and n is not None
            at = plain_leaf(doc_id, text, lang, source, n + 1) if hit else leaf
            for left, right in path:
                at = digest("".join([*left, at, *right]))
            proof = digest("".join(h for left, right in path for h in left + right))
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], proof, at, at == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents(n, langs=("en", "de", None), step=1):
    return [(i * step, f"text {i}" * (i % 5), langs[i % len(langs)], None if i % 4 == 0 else f"s{i % 3}", None if i % 9 == 0 else i) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 23, 200])
@pytest.mark.parametrize("fanout,block", [(2, 4), (3, 9), (2, 1024), (16, 4)])
def test_manifest_equals_plain_loops(spark, n, fanout, block):
    if n == 200 or block != 1024:
        rows = documents(n)
        assert rows_of(merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout, block=block)) == plain(rows, fanout)


def test_ids_of_all_sizes_nulls_repeats_and_crowds(spark):
    """Negative and huge ids, null ids, one id on most rows, equal rows, and nodes that must be split by leaves and runs."""
    rows = [(x, "a", "en", "s", 1) for x in (-(1 << 63), -(1 << 40), -5, 0, 1 << 20, 1 << 41, (1 << 63) - 1)]
    rows += [(7, f"t{i}", "en", "s", i) for i in range(60)] + [(9, "same", "en", "s", 1)] * 30
    rows += [(None, f"t{i}", "de", None, None) for i in range(5)] + [(3, "", "", "", 0), (3, None, "", "", 0), (4, "ß" * 9000, "ü", "é", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for hot in (8, 65_536):
        assert rows_of(merkle.manifest(df, hot_rows=hot, block=16)) == plain(rows)


def test_extra_columns_and_many_groups(spark):
    rows = documents(150, langs=tuple(f"l{i}" for i in range(40)), step=977)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS `rank`", "2 AS `group`", "3 AS n", "4 AS leaf", "5 AS place", "6 AS hash")
    got = rows_of(merkle.manifest(df, block=8))
    assert got == plain(rows)
    assert {r[6] for r in got if zlib.crc32(str(r[0]).encode()) % 7} == {True}


def test_query_equals_sql(spark, sf):
    assert_same(queries.op11_merkle(spark, sf), queries.OP11_SQL, sf)
