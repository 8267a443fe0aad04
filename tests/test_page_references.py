"""Pages whose titles are cut within a reference, as the larger tables have them, against the queries' SQL."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from filigraph.functions import text as tx
from filigraph.plans import more_queries, queries
from tests.oracle import TABLES, assert_same

CUTS = ["&a", "&am", "&amp", "&amp;", "&quo", "&quot", "&copy", "&amp;amp", "&amp;&amp", "&eacute", "", None]


@pytest.fixture(scope="module")
def cut_pages(tmp_path_factory, sf):
    """The smallest tables with pages of such titles, each as a section's first line too."""
    home = tmp_path_factory.mktemp("pages")
    for t in TABLES:
        if t != "pages":
            os.symlink(f"{sf}/{t}.parquet", home / f"{t}.parquet")
    html = [c and f"<html><title>Of&amp;&amp;{c}</title><p>one</p><h1>Reed%%% nting$$$ of{c}</h1><p>two{c} three &lt;{c}</p><p>&copy; 2024</p></html>" for c in CUTS]
    ids = list(range(1, len(html) + 1))
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": [f"https://example/{i}" for i in ids], "html": html}), home / "pages.parquet")
    return str(home)


def test_incremental_sections(spark, cut_pages):
    assert_same(more_queries.incremental_sections(spark, cut_pages), more_queries.INCREMENTAL_SQL, cut_pages)


def test_page_section(spark, cut_pages):
    assert_same(queries.page_section(spark, cut_pages), queries.PAGE_SECTION_SQL, cut_pages)


def test_page_text(spark, cut_pages):
    assert_same(queries.page_text(spark, cut_pages), queries.PAGE_TEXT_SQL, cut_pages)


def test_names_without_semicolon(spark):
    """Decoded or left, as asked; numbers are decoded either way."""
    row = spark.createDataFrame([("&copy 2 &ampx &#65 &eacute; &notit; &amp;amp",)], "v string").select(tx.decode_entities(F.col("v")).alias("r"), tx.decode_entities(F.col("v"), bare=False).alias("left")).first()
    assert row["r"] == "\u00a9 2 &x A \u00e9 \u00acit; &amp" and row["left"] == "&copy 2 &ampx A \u00e9 &notit; &amp"
