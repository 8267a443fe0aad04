"""Overlapping word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigraph.functions.text import words

WORDS_PER_PAGE = 250


def chunk(texts: DataFrame, key: str = "ticker", text_col: str = "text", size: int = 512, overlap: int = 64, section: str = "Item 1") -> DataFrame:
    """The chunk table of a ``key, text`` table: windows of ``size`` words, each ``overlap`` words into the one before.

    The last window ends with the text. Texts without words have no chunks. No rows are shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    split = texts.select(F.col(key), words(F.coalesce(F.col(text_col), F.lit(""))).alias("all_words")).where(F.size("all_words") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("all_words") - size) / F.lit(step)).cast("int"))
    window = lambda i: F.struct(
        i.alias("n"),
        (i * step).cast("bigint").alias("start_word"),
        F.least(i * step + size, F.size("all_words")).cast("bigint").alias("end_word"),
        F.array_join(F.slice("all_words", i * step + 1, F.lit(size)), " ").alias("text"),
    )
    windows = split.select(F.col(key), F.explode(F.transform(F.sequence(F.lit(0), last), window)).alias("w"))
    return windows.select(
        F.format_string("%s_chunk_%04d", F.col(key).cast("string"), "w.n").alias("chunk_id"),
        F.col(key),
        F.lit(section).alias("section"),
        (F.floor(F.col("w.start_word") / WORDS_PER_PAGE) + 1).cast("bigint").alias("page_estimate"),
        "w.start_word", "w.end_word", "w.text",
    )


def ingest_summary(texts: DataFrame, key: str = "ticker", text_col: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """``key, chars, chunks`` without building the chunks."""
    n = F.size(words(F.coalesce(F.col(text_col), F.lit(""))))
    count = F.when(n == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((n - size) / F.lit(size - overlap))) + 1)
    return texts.select(F.col(key), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("chars"), count.cast("bigint").alias("chunks"))


def explore(chunks: DataFrame, keyword: str | None = None, pages: tuple[int, int] | None = None) -> DataFrame:
    """Chunks with the keyword (a pattern, any case) on pages from the first to the last, both included."""
    hit = F.coalesce(F.col("text").rlike(f"(?iu){keyword}"), F.lit(False)) if keyword else F.lit(True)
    return chunks.where(hit).where(F.col("page_estimate").between(*pages) if pages else F.lit(True))


def explore_counts(chunks: DataFrame, keyword: str | None = None, pages: tuple[int, int] | None = None) -> DataFrame:
    """One row: chunks shown, all chunks and the last page (2 at least)."""
    hit = F.coalesce(F.col("text").rlike(f"(?iu){keyword}"), F.lit(False)) if keyword else F.lit(True)
    on = F.col("page_estimate").between(*pages) if pages else F.lit(True)
    return chunks.agg(
        F.count_if(hit & on).alias("shown"), F.count(F.lit(1)).alias("total"), F.greatest(F.lit(2), F.max("page_estimate")).alias("last_page")
    )
