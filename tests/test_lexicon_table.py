"""Keywords from tables: the same records as with keywords in the plan, for few and for very many."""

import random

import pytest
from pyspark.sql import functions as F

from filigraph.operators import extraction, lexicon_table
from filigraph.operators.lexicon import Lexicon
from filigraph.operators.lexicon_table import KEYWORDS, LexiconTable


def hits_of(spark, rows, texts):
    table = spark.createDataFrame(rows, KEYWORDS)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    found = df.select("i", lexicon_table.finder(table)(F.col("t")).alias("h")).collect()
    return [None if r["h"] is None else [(h["category"], h["keyword"], h["at"]) for h in r["h"]] for r in sorted(found, key=lambda r: r["i"])]


def test_first_places_of_overlapping_repeated_and_odd_keywords(spark):
    rows = [("k", "b", 1, "she", 0), ("k", "a", 0, "he", 1), ("k", "a", 0, "hers", 0), ("k", "c", 2, "he", 0), ("k", "c", 2, "", 1), ("k", "c", 2, None, 2), ("k", "c", 2, "ä😀", 3), ("k", "c", 2, "no", 4)]
    got = hits_of(spark, rows, ["ushers he", "", None, "😀ä😀 he", "x" * 200_000 + "she"])
    assert got[0] == [("a", "hers", 2), ("a", "he", 2), ("b", "she", 1), ("c", "he", 2), ("c", "", 0)]
    assert got[1] == [("c", "", 0)] and got[2] is None
    assert got[3] == [("a", "he", 4), ("c", "he", 4), ("c", "", 0), ("c", "ä😀", 1)] and got[4][1] == ("b", "she", 200_000)


def test_no_keywords_and_too_many(spark, monkeypatch):
    assert hits_of(spark, [], ["text"]) == [[]]
    monkeypatch.setattr(lexicon_table, "MAX_CHARACTERS", 3)
    with pytest.raises(ValueError):
        lexicon_table.finder(spark.createDataFrame([("k", "a", 0, "long", 0)], KEYWORDS))


def test_a_hundred_thousand_keywords_against_plain_search(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(3, 9)))
    keys = sorted({word() for _ in range(140_000)})[:100_000]
    texts = [" ".join(word() for _ in range(80)) for _ in range(25)]
    got = hits_of(spark, [("k", "", 0, k, i) for i, k in enumerate(keys)], texts)
    for text, hits in zip(texts, got):
        assert [(k, at) for _, k, at in hits] == [(k, text.find(k)) for k in keys if k in text]


def test_records_equal_those_of_the_plan(spark):
    """Ties, a type whose first keyword has a short sentence, more categories than are kept, repeated keywords."""
    lexicon = Lexicon(
        objectives={"growth": ("grow", "market"), "cost": ("cut",), "green": ("esg", "green"), "new": ("new",), "last": ("we",)},
        capabilities=("cloud", "data", "cloud", "we", "new", "market", "cut"), risks={f"r{i}": (k, "we") for i, k in enumerate(("zzz", "cyber", "law", "new", "cut", "grow"))},
    )
    texts = [
        "We grow. We want to win the whole market with new green ideas and cut costs everywhere, says the ESG officer" + " more" * 10, "CLOUD data CYBER law. " * 12, "no stop here we grow " + "x" * 300,
        "short we", None, "ünïcödé İstanbul grow green. " * 9, "nothing. " * 30,
    ]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "ticker string, text string")
    rows = lambda x: sorted((r["Company"]["ticker"], repr(r)) for r in extraction.extract(docs, x).collect())
    assert rows(LexiconTable.of(spark, lexicon)) == rows(lexicon)
    assert rows(LexiconTable.of(spark, Lexicon())) == rows(Lexicon())
