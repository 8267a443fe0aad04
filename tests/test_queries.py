"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import pytest

from filigraph.plans import graph_queries, index_queries, io_queries, more_queries, queries
from tests.oracle import assert_same

SPECS = queries.SPECS | io_queries.SPECS | graph_queries.SPECS | index_queries.SPECS | more_queries.SPECS


@pytest.mark.parametrize("name", [n for n, (_, sql) in SPECS.items() if sql])
def test_query_equals_sql(spark, sf, name):
    query, sql = SPECS[name]
    assert_same(query(spark, sf), sql, sf)


def test_ask_gives_one_row(spark, sf):
    rows = SPECS["ask_hybrid"][0](spark, sf).collect()
    assert len(rows) == 1 and rows[0]["steps"].endswith("KG-RAG Reasoner") and rows[0]["answer"].startswith("**Document 1**")
    assert rows[0]["spans"] > 0 and rows[0]["paths"] > 0 and "**Key Findings from 10-K:**" in rows[0]["answer"]


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(SPECS) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_columns_and_filters(spark, sf):
    plan = SPECS["vector_topk_prefilter"][0](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan and "TakeOrderedAndProject" in plan
    chunks = SPECS["chunk_documents"][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in chunks and "lang" not in chunks.split("ReadSchema")[1]


def test_all_works_without_the_training_data_operators(tmp_path):
    """On a copy without their folders and the pipeline's module, or with the module alone, the rest is there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    home = Path(__file__).resolve().parent.parent
    for keep_module in (True, False):
        copy = tmp_path / f"copy_{keep_module}"
        shutil.copytree(home, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache", ".hypothesis") or (n == "llm") or (n == "corpus_pipeline.py" and not keep_module)])
        code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op1') or n == 'pipeline' for n in q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert out.stdout.split() == [str(len(SPECS)), "False"], out.stderr[-500:]
