"""Token counts with a digest cache.

Counts are stored by the digest of the (normalised) content and the digest of the tokenizer file. A run joins its
digests to the stored counts, encodes one text of each digest that is missing, and appends these counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigraph.llm.shared import SMALL_ROWS, cut, look_up, sized, text_or_empty

#: The split of byte-level vocabularies, a fixed value of their format, with letters and digits as far as _PLAIN goes.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile(r"[^\t\n\r -~À-ÿ]")


class Counter:
    """Counts tokens as the tokenizers library does, which encodes each distinct word once while it is remembered.

    Words are told apart only in byte-level vocabularies without normaliser and in texts of
    plain characters without special strings; the library encodes all other texts whole.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            parts = {k: v for k, v in json.load(file).items() if k != "model"}
        self.by_word = not parts.get("normalizer") and not parts.get("post_processor") and parts["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }
        self.special = [t["content"] for t in parts.get("added_tokens", [])]
        self.remembered, self.seen = remembered, {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        plain = [self.by_word and not _UNUSUAL.search(t) and not any(s in t for s in self.special) for t in texts]
        words = [_SPLIT.findall(t) if p else [] for t, p in zip(texts, plain)]
        others = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        fresh = list(set().union(*words) - self.seen.keys())
        if len(self.seen) + len(fresh) > self.remembered:
            self.seen.clear()
            fresh = list(set().union(*words))
        self.seen.update(zip(fresh, self.whole(fresh)))
        seen = self.seen
        return [sum([seen[w] for w in ws]) if p else next(others) for ws, p in zip(words, plain)]


_COUNTERS: dict[str, Counter] = {}


def counter_at(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def tokenizer_digest(path: str) -> str:
    """What names a tokenizer version in the cache."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def stored_counts(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) that the cache has for one tokenizer version, one row per digest."""
    try:
        rows = spark.read.schema("digest binary, n_tokens long").parquet(f"{cache_path}/tokenizer={tokenizer}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of a (digest, text) table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 200):
                batch = big.slice(at, 200)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter_at(path).counts(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def texts_of_misses(texts: DataFrame, digests: DataFrame, stored: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(digest, text), one row for each of ``digests`` (digest, n) that ``stored`` lacks.

    A missing digest of one row is encoded where its text is read. Of one with more rows each task sends one text at most, and the least stays. The rows to
    encode are told by the shorter list of two, those that are single misses and those that are not, by broadcast; if both are long, texts are shuffled.
    """
    known = stored.select("digest", F.lit(True).alias("known"))
    state = cut(digests.join(known, "digest", "left").select("digest", (F.col("known").isNull() & (F.col("n") == 1)).alias("single"), (F.col("known").isNull() & (F.col("n") > 1)).alias("several")), "misses")
    sizes = state.agg(F.count_if("single").alias("single"), F.count_if(~F.col("single")).alias("other"), F.count_if("several").alias("several")).first()
    others, singles = state.where(~F.col("single")).select("digest"), state.where("single").select("digest")
    if sizes["other"] <= small_rows:
        alone = texts.join(F.broadcast(others), "digest", "left_anti")
    else:
        alone = texts.join(sized(singles, sizes["single"], small_rows), "digest", "left_semi")
    if not sizes["several"]:
        return alone
    copies = texts.join(sized(state.where("several").select("digest"), sizes["several"], small_rows), "digest", "left_semi")
    return alone.unionByName(copies.groupBy("digest").agg(F.min("text").alias("text")))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per input row, by whole texts.

    The content is digested as it is, since byte-level vocabularies tell all texts apart. A null text is empty and has no
    tokens. Ids may be null or repeat; a text is encoded once however many rows have it. ``tokenizer_path`` must be readable on
    every machine, ``cache_path`` is a URI that they share. Two runs that append the same digest do no harm.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), digest, F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    digests = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "distinct_digests")
    texts = texts_of_misses(docs.select(digest, text.alias("text")), digests, stored_counts(spark, cache_path, tokenizer))
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) < cores:  # a file for each split that had rows: fewer of them than cores, so texts are dealt out
        texts = texts.repartition(2 * cores)
    encode_misses(texts, tokenizer_path).write.mode("append").parquet(f"{cache_path}/tokenizer={tokenizer}")
    counted = look_up(rows, cut(digests.join(stored_counts(spark, cache_path, tokenizer), "digest"), "counts"), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
