"""What the training-data operators share: sized joins, verdicts on rows, and checked column access.

Executors can be lost at any time, so every lineage cut is a written Parquet table below
the folder that the session names in ``spark.checkpoint.dir``; nothing lives on one machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigraph.work import clear, cut, discard, new_path, workspace

__all__ = ["clear", "cut", "discard", "documents", "keep_rows", "look_up", "new_path", "sized", "small_batches", "text_key", "text_or_empty", "workspace"]

#: Tables of up to so many rows of a few numbers may be broadcast; longer ones are shuffled.
SMALL_ROWS = 500_000


def sized(table: DataFrame, rows: int, small_rows: int = SMALL_ROWS) -> DataFrame:
    """A table of ``rows`` (counted) narrow rows for the smaller side of a join: broadcast if small, else hashed by the join's key."""
    return F.broadcast(table) if rows <= small_rows else table.hint("shuffle_hash")


def look_up(rows: DataFrame, table: DataFrame, key: str, hottest: int = 1024) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per ``key`` and in ``n`` how many rows have it.

    The ``hottest`` keys at most, those of more than one row in ``hottest`` thousand, meet their rows by broadcast, all others by shuffle.
    """
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    is_hot = (F.col("n") >= 1000) & (F.col("n") * hottest > total)
    hot, cold = table.where(is_hot).drop("n"), table.where(~is_hot).drop("n")
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(cold, key))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, plans that run give Python workers ``rows`` rows at a time, for rows that hold much. The session's setting comes back at the end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_key(column: str = "text") -> Column:
    """64 bits of a text, which with a document's id name its rows."""
    return F.xxhash64(text_or_empty(column))


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text", small_rows: int = SMALL_ROWS) -> DataFrame:
    """The rows of ``docs``, with all columns, whose id and text ``verdicts`` let stay; of rows that repeat both, one.

    ``verdicts`` has ``doc_id, key`` (:func:`text_key`) ``, stays``, a row for each of ``docs`` or of those that don't simply stay. Only (id, key) of rows that go or
    repeat meet the texts: broadcast if they are few, else by a shuffle on both. Ids may be null.
    """
    marks = verdicts.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    marks = cut(marks.drop("n"), "marks")
    sizes = {r["stays"]: r["n"] for r in marks.groupBy("stays").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns, key = [docs[c] for c in docs.columns], F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    same = lambda m: docs[id_col].eqNullSafe(m["doc_id"]) & (key == m["key"])
    out = docs.join(sized(marks, sum(sizes.values()), small_rows), same(marks), "left_anti").select(columns)
    if not sizes.get(True):
        return out
    repeated = marks.where("stays")
    again = docs.join(sized(repeated, sizes[True], small_rows), same(repeated))
    row = F.struct(*columns)
    one = again.groupBy(repeated["doc_id"], repeated["key"]).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return out.unionAll(one.select("row.*"))


def text_or_empty(column: str = "text") -> Column:
    """A null text counts as the empty text everywhere in this subpackage."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
