"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filigraph.llm import exact_dedup, mixing, pieces, simhash, toxicity
from filigraph.llm.shared import cut, discard, documents
from filigraph.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (0.8 or more of their five-word runs in common) the one with the smallest doc_id stays."""
    ship(spark)
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0, 1 or 2 times) as the mix of sources takes it."""
    ship(spark)
    return mixing.apply_mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token digests of every row of the mix."""
    ship(spark)
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Hashed models and random rounding are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), f"pipeline_{name}")
        discard(docs)  # the table of the stage before, once it is read
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
