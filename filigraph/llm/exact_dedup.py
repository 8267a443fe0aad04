"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of all digests find the few texts that could own a large share of the
rows. Their groups are counted exactly, and the verified winners (at most ``counters`` rows)
are broadcast, so that hot rows never shuffle. All other digests take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigraph.llm.shared import cut, keep_rows, text_key, text_or_empty


def shrink(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The Misra-Gries step: lowers all counts by the (counters + 1)-th largest and drops what is spent.

    The sum of all that is ever taken from one digest stays at or below n / (counters + 1).
    """
    if len(counts) <= counters:
        return counts
    least = sorted(counts.values(), reverse=True)[counters]
    return {k: v - least for k, v in counts.items() if v > least}


def misra_gries(digests: DataFrame, column: str, counters: int) -> DataFrame:
    """(digest, estimate): at most ``counters`` rows that hold every digest of frequency over 2 n / (counters + 1).

    Each task emits one summary of at most ``counters`` rows; sums of summaries are a summary
    of the union, so the merge is a partial aggregation and a bounded top list.
    An empty input gives no rows; null digests are not counted.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            for digest, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
                if digest is not None:
                    counts[digest] = counts.get(digest, 0) + n
            counts = shrink(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "estimate"]
        )

    summaries = digests.select(F.col(column).alias("digest")).mapInArrow(summarise, "digest binary, estimate long")
    merged = summaries.groupBy("digest").agg(F.sum("estimate").alias("estimate"))
    return merged.orderBy(F.desc("estimate"), "digest").limit(counters)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, counters: int = 1024
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when ``normalise`` (by default the text itself) is identical. Of equal texts
    the row with the largest id stays. A null text is the empty text, so all of these are one
    group. A null id never wins over another id. Rows that repeat both id and text share their verdict.
    Other columns of the input are ignored; an empty input gives an empty result.
    """
    normal = text_or_empty(text_col) if normalise is None else F.coalesce(normalise, F.lit(""))
    return _verdicts(docs.select(F.col(id_col).alias("doc_id"), normal.alias("text")), counters)


def _verdicts(texts: DataFrame, counters: int, *extra: str) -> DataFrame:
    """:func:`exact_dedup` of (doc_id, text), with ``extra`` columns of the rows."""
    digests = cut(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), *extra), "digests")
    rows = digests.count()
    frequent = misra_gries(digests, "digest", counters).where(F.col("estimate") > rows / (counters + 1)).select("digest")
    group = (F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    winners = cut(digests.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*group), "winners")
    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*group), "digest")
    return hot.unionByName(cold).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *extra,
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, counters: int = 1024) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts: the one that :func:`exact_dedup` keeps.

    A verdict is of an id and its text, so another text with the same id has its own. Of rows that repeat id and text
    one stays, and of a group without any id one row. Nulls are empty texts. See :func:`keep_rows` for what meets the texts.
    """
    normal = text_or_empty(text_col) if normalise is None else F.coalesce(normalise, F.lit(""))
    verdicts = _verdicts(docs.select(F.col(id_col).alias("doc_id"), normal.alias("text"), text_key(text_col).alias("key")), counters, "key")
    return keep_rows(docs, verdicts.select("doc_id", "key", F.col("kept").alias("stays")), id_col, text_col)
