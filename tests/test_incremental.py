"""Incremental builds touch what changed and give what a full build gives."""

import pytest
from pyspark.sql import functions as F

from filigraph.plans import incremental as inc
from filigraph.plans.build import build
from filigraph.sources import versions
from filigraph.work import new_path

SCHEMA = "ticker string, html string"


def page(words):
    return f"<html><body><p>ITEM 1. BUSINESS</p><p>Our mission is to {words}. We plan to expand cloud revenue growth. Risks of regulation and competition remain.</p></body></html>"


ROWS = [(f"T{i}", page(f"serve people {i}")) for i in range(8)] + [(None, page("be nobody")), ("NULL", None), ("TWICE", page("a")), ("TWICE", page("b"))]


def tables(b):
    pick = {"sections": ["ticker", "text"], "chunks": ["chunk_id", "text"], "nodes": ["id", "label", "ord"], "edges": ["src", "dst", "rel", "ord"]}
    return {name: sorted(map(repr, getattr(b, name).select(*cols).collect())) for name, cols in pick.items()}


@pytest.fixture(scope="module")
def runs(spark):
    path = new_path(spark, "incremental")
    first = inc.refresh(spark.createDataFrame(ROWS, SCHEMA), path)
    changed = [(t, page("change it all") if t == "T3" else h) for t, h in ROWS if t != "T5"] + [("NEW", page("be new"))]
    second = inc.refresh(spark.createDataFrame(changed, SCHEMA).repartition(3), path)
    return path, first, second, changed


def test_only_changes_are_built(spark, runs):
    path, first, second, changed = runs
    assert (first.version, first.built, first.kept, first.gone) == (1, 11, 0, 0)
    assert (second.version, second.built, second.kept, second.gone) == (2, 2, 9, 1)
    assert sorted(r["ticker"] for r in spark.read.parquet(f"{path}/parts/{versions.describe(spark, path)[1]['parts'][-1]}/sections").collect()) == ["NEW", "T3"]
    parts = {r["filing"]: int(r["part"].split("-")[0]) for r in inc.manifest(spark, path).collect()}
    assert parts == {"T3": 2, "NEW": 2} | {t: 1 for t, _ in ROWS if t not in ("T3", "T5")}


def test_equals_a_full_build(spark, runs):
    path, _, _, changed = runs
    assert tables(inc.open_build(spark, path)) == tables(build(spark.createDataFrame(changed, SCHEMA)))
    assert tables(inc.open_build(spark, path, 1)) == tables(build(spark.createDataFrame(ROWS, SCHEMA)))


def test_nothing_new_and_compaction(spark, runs):
    path, _, _, changed = runs
    before = tables(inc.open_build(spark, path))
    again = inc.refresh(spark.createDataFrame(changed, SCHEMA).withColumn("extra", F.lit(1)), path)
    assert (again.version, again.built, versions.published(spark, path)) == (2, 0, [1, 2])
    assert inc.compact(spark, path) == 3 and tables(inc.open_build(spark, path)) == before
    delivery = inc.refresh(spark.createDataFrame([("T0", page("come again"))], SCHEMA), path, gone=False)
    assert (delivery.built, delivery.gone) == (1, 0) and len(tables(inc.open_build(spark, path))["sections"]) == len(before["sections"])


def test_a_failed_run_changes_nothing(spark, monkeypatch):
    path = new_path(spark, "incremental")
    inc.refresh(spark.createDataFrame(ROWS[:2], SCHEMA), path)
    before = tables(inc.open_build(spark, path))

    def fail(*_):
        raise RuntimeError("broken")

    with monkeypatch.context() as m:
        m.setattr(inc.extraction, "edges", fail)
        with pytest.raises(RuntimeError):
            inc.refresh(spark.createDataFrame(ROWS[:4], SCHEMA), path)
    assert versions.published(spark, path) == [1] and tables(inc.open_build(spark, path)) == before
    again = inc.refresh(spark.createDataFrame(ROWS[:4], SCHEMA), path)  # what the failed run left is in nobody's way
    assert (again.version, again.built, again.kept) == (2, 2, 2)


def test_empty(spark):
    path = new_path(spark, "incremental")
    assert inc.refresh(spark.createDataFrame([], SCHEMA), path) == inc.Run(0, 0, 0, 0)
    with pytest.raises(FileNotFoundError):
        inc.open_build(spark, path)
