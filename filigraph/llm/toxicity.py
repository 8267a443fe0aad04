"""Toxic passages by maximum-scoring segment search.

Tokens score by their log-odds between the classes under an informative Dirichlet prior. A
linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa); the extreme-value
law of such maxima in clean texts (Karlin and Altschul) tells which are significant, and the
evidence of all significant segments becomes one score between 0 and 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigraph.llm.shared import cut, text_or_empty

WORD = re.compile(r"\w+")
PREFIXES = (6, 5, 4)


@dataclass
class Model:
    """Everything that scoring needs; at most ``max_tokens`` entries in ``weights``."""

    weights: dict[str, float]
    drift: float
    rate: float = 1.0
    ln_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    _seen: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        """A word's own log-odds, else those of its longest known beginning, else the drift."""
        found = self.weights.get(word)
        for n in PREFIXES if found is None else ():
            if len(word) > n and (found := self.weights.get(f"{word[:n]}*")) is not None:
                break
        return self.drift if found is None else found

    def scores(self, words: list[str]) -> list[float]:
        seen = self._seen
        for word in set(words).difference(seen):
            seen[word] = self.weight(word)
        out = list(map(seen.__getitem__, words))
        if len(seen) > 200_000:
            seen.clear()
        if out and max(out) > 0:  # a repeat is no new evidence while the drift since then hasn't used up the word's score
            counted: dict[str, int] = {}
            for i, word in enumerate(words):
                if out[i] > 0:
                    if word in counted and (counted[word] - i) * self.drift < out[i]:
                        out[i] = self.drift
                    else:
                        counted[word] = i
        return out

    def evidence(self, text: str) -> tuple[float, list[tuple[float, int, int]]]:
        """The summed significance, and the significant segments (score, first character, end character)."""
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)] if text else []
        words = [text[a:b].lower() for a, b in spans]
        scores = self.scores(words)
        if not scores or max(scores) <= 0:
            return 0.0, []
        limit = self.ln_k + math.log(len(words))
        found = [(s, a, b) for s, a, b in segments(scores) if self.rate * s > limit]
        return sum(self.rate * s - limit for s, _, _ in found), [(s, spans[a][0], spans[b - 1][1]) for s, a, b in found]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * math.log1p(evidence) + self.offset))))


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), by the linear scan of Ruzzo and Tompa."""
    total = [0.0, *accumulate(scores)]
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, place of the nearest lower
    for i, score in enumerate(scores):
        if score <= 0:
            continue
        left, right, start = total[i], total[i + 1], i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, start, i + 1, j))
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b - a, s, e) for a, b, s, e, _ in stack]


def _tokens(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


def _sketch(text: str) -> tuple[int, int]:
    """Two minima over the hashes of a text's three-word runs."""
    words = text.split() or [""]
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    low = [min(xxhash.xxh64_intdigest(r, seed) for r in runs) for seed in (1, 2)]
    return low[0] >> 1, low[1] >> 1


def _counts(sample: DataFrame) -> DataFrame:
    """(token, toxic, clean): in how many texts of each class a token is."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for token in _tokens(text):
                    counts.setdefault(token, [0, 0])[1 - label] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([v[0] for v in counts.values()], pa.int64()),
                    pa.array([v[1] for v in counts.values()], pa.int64()),
                ],
                ["token", "toxic", "clean"],
            )

    parts = sample.select("text", "label").mapInArrow(explode, "token string, toxic long, clean long")
    return parts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, toxic_texts: int, clean_texts: int, prior_share: float, caution: float, max_tokens: int) -> dict[str, float]:
    """(token, weight) of the tokens whose log-odds are sure, at most ``max_tokens``, the surest first.

    The prior counts as ``prior_share`` of all texts in each class, dealt to tokens by their share of the
    texts. Among V tokens without any bearing the largest deviation is about sqrt(2 ln V); a token must lie
    ``caution`` times as far from zero. A weight is the log-odds less one deviation. A word's beginning
    only counts if no single word makes up most of its texts. Odds of less than two to one say nothing.
    """
    known = cut(counts.where(F.col("toxic") + F.col("clean") >= 3), "token_counts")
    min_z = caution * math.sqrt(2 * math.log(max(2, known.count())))
    prior = prior_share * (toxic_texts + clean_texts)
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(toxic_texts + clean_texts))
    a, b = F.col("toxic") + F.lit(prior) * share, F.col("clean") + F.lit(prior) * share
    of = lambda x, n: F.log(x / (F.lit(n + prior) - x + F.lit(1.0)))
    delta = of(a, float(toxic_texts)) - of(b, float(clean_texts))
    texts = F.greatest("toxic", "clean").alias("texts")
    scored = known.select("token", delta.alias("delta"), F.sqrt(1 / a + 1 / b).alias("sd"), texts)
    weight = F.col("delta") - F.signum("delta") * F.col("sd")
    sure = scored.where((F.abs("delta") >= min_z * F.col("sd")) & (F.abs(weight) >= math.log(2))).select(
        "token", weight.alias("weight"), "texts", F.abs(F.col("delta") / F.col("sd")).alias("z")
    )
    rows = sure.orderBy(F.desc("z"), "token").limit(max_tokens).collect()
    best: dict[str, int] = {}
    for r in rows:
        for n in PREFIXES:
            if len(r["token"]) > n and not r["token"].endswith("*"):
                best[f"{r['token'][:n]}*"] = max(r["texts"], best.get(f"{r['token'][:n]}*", 0))
    return {r["token"]: float(r["weight"]) for r in rows if best.get(r["token"], 0) < 0.7 * r["texts"]}


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_class: int) -> DataFrame:
    """(text, label, fold) of at most ``rows_per_class`` labelled rows of each class, and of most groups of near copies one row.

    The rows come by the order of a hash of their ids. Only these ids are broadcast (16 bytes a row).
    Rows that share one of two minima over the hashes of three-word runs count as copies, since
    words of one text that was copied often would else look typical of its label. Null ids or
    labels are not taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).select(
        "doc_id", F.col(label_col).cast("int").alias("label")
    )
    order = (F.xxhash64("doc_id"), "doc_id")
    taken = [known.where(F.col("label") == k).orderBy(*order).limit(rows_per_class) for k in (0, 1)]
    ids = F.broadcast(taken[0].unionByName(taken[1]))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(ids, "doc_id")
    rows = rows.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_sketch(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)]], [*batch.schema.names, "m0", "m1"])

    rows = rows.select("doc_id", "text", "label", "fold")
    rows = rows.mapInArrow(sketched, "doc_id long, text string, label int, fold long, m0 long, m1 long")
    for mark in ("m0", "m1"):
        rows = rows.groupBy(mark).agg(F.min_by(F.struct(*[c for c in rows.columns if c != mark]), "doc_id").alias("row")).select(mark, "row.*")
    return rows.select("text", "label", "fold")


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a light ridge. A class weighs the root of its size."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.array([1.0, -1.0])
    weight = np.where(y > 0, 1 / np.sqrt(max(1.0, y.sum())), 1 / np.sqrt(max(1.0, (1 - y).sum())))
    weight /= weight.sum()

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * beta @ beta)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - ridge * beta
        hess = (design * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows_per_class: int = 20_000, prior_share: float = 0.05,
    caution: float = 0.8, max_tokens: int = 50_000, drift: float = -0.01,
) -> Model:
    """Fits tokens, extreme-value law and calibration on a bounded sample of labelled rows.

    The sample has at most ``rows_per_class`` rows of each class and one row of each text; token
    weights come from four fifths of it, the law and the calibration from the rest. With
    no toxic or no clean rows the model scores every text by the base rate.
    """
    sample = cut(labelled_sample(docs, labels, label_col, rows_per_class), "toxic_sample")
    held = F.col("fold") == 4
    sizes = {(r["held"], r["label"]): r["n"] for r in sample.groupBy(held.alias("held"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
    if not toxic or not clean:
        ones, all_rows = toxic + sizes.get((True, 1), 0), sum(sizes.values())
        return Model({}, drift, slope=0.0, offset=math.log((ones + 0.5) / (all_rows - ones + 0.5)))
    model = Model(log_odds(_counts(sample.where(~held)), toxic, clean, prior_share, caution, max_tokens), drift)

    def ups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many words of the texts score which positive amount (in tenths), and under 0 all words."""
        for batch in batches:
            counts: dict[int, int] = {0: 0}
            for text in batch.column(0).to_pylist():
                scores = model.scores(WORD.findall(text.lower()))
                counts[0] += len(scores)
                for s in scores:
                    if s > 0:
                        counts[max(1, round(10 * s))] = counts.get(max(1, round(10 * s)), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["tenths", "n"])

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's number of words and best segment."""
        for batch in batches:
            scored = [model.scores(WORD.findall(t.lower())) for t in batch.column(0).to_pylist()]
            best = [max((s for s, _, _ in segments(x)), default=0.0) for x in scored]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in scored], pa.int64()), pa.array(best, pa.float64())], ["n", "best"])

    check = sample.where(held) if sizes.get((True, 1), 0) and sizes.get((True, 0), 0) else sample
    texts = check.where(F.col("label") == 0).select("text")
    histogram = {r["tenths"]: r["n"] for r in texts.mapInArrow(ups, "tenths int, n long").groupBy("tenths").agg(F.sum("n").alias("n")).collect()}
    words = max(1, histogram.pop(0, 1))
    shares = {t / 10: n / words for t, n in histogram.items()} or {max([0.1, *model.weights.values()]): 0.5 / words}
    model.drift = min(drift, -2 * sum(s * p for s, p in shares.items()))  # a clean text must fall on the whole
    model._seen.clear()
    model.rate = _decay(shares, model.drift)
    seen = texts.mapInArrow(maxima, "n long, best double").where("n > 0").toPandas()  # at most rows_per_class pairs of numbers
    if len(seen):
        model.ln_k = math.log(len(seen) / float((seen["n"] * np.exp(-model.rate * seen["best"])).sum()))

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([model.evidence(t)[0] for t in batch.column(0).to_pylist()], pa.float64())],
                ["label", "evidence"],
            )

    fit = check.select("text", "label").mapInArrow(evidences, "label int, evidence double").toPandas()
    model.slope, model.offset = _fit_logistic(np.log1p(fit["evidence"].to_numpy()), fit["label"].to_numpy(dtype=float))
    model._seen.clear()
    return model


def _decay(shares: dict[float, float], drift: float) -> float:
    """The rate at which maxima in clean texts get rarer: the positive root of E[exp(rate * score)] = 1."""
    rest = 1 - sum(shares.values())
    value = lambda x: sum(p * math.exp(min(600.0, x * s)) for s, p in shares.items()) + rest * math.exp(x * drift) - 1
    low, high = 0.0, 1e-3
    while value(high) < 0:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def score(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """``doc_id, score, predicted`` and, if asked for, ``spans`` (score, start, end in characters).

    Whole texts are read. A null or empty text, or one without words, gets the score of no
    evidence. One output row per input row, null ids included.
    """
    schema = "doc_id long, score double, predicted int, spans array<struct<score:double,start:long,end:long>>"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [model.evidence(t) for t in batch.column(1).to_pylist()]
            p = [model.probability(e) for e, _ in found]
            spans = [[{"score": s, "start": a, "end": b} for s, a, b in x] if with_spans else None for _, x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(spans, kind)],
                ["doc_id", "score", "predicted", "spans"],
            )

    out = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(scored, schema)
    return out if with_spans else out.drop("spans")


def held_out(column: str = "doc_id"):
    """The rows that no model learns from: a fifth of the ids, by their CRC."""
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``, by a model of the labels outside the held-out fifth."""
    model = train(docs, labels.where(~held_out()), **options)
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns, without the texts that the model rejects (score of 0.5 or more).

    The verdict is taken where the row is read: no text is shuffled.
    """
    model = train(docs, labels.where(~held_out()), **options)

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.probability(model.evidence(t)[0]) >= 0.5).astype(bool)

    return docs.where(~rejected(text_or_empty()))
