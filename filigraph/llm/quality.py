"""Quality of documents by histogram gradient-boosted trees over statistics of their text.

Every text becomes a row of numbers: shares of kinds of characters, repetition of words, word pairs, runs and lines, entropies and how well it
compresses. Trees are grown on histograms of binned values by the gradients of the logistic loss, then
laid out in flat arrays, so that a batch of texts walks all trees at once in numpy.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigraph.llm.shared import cut, text_or_empty
from filigraph.llm.toxicity import _sketch

FEATURES = (
    "chars", "letters", "digits", "upper", "spaces", "newlines", "stops", "symbols", "non_ascii", "char_entropy", "top_char", "kinds_of_chars",
    "words", "word_length", "word_length_sd", "longest_word", "distinct_words", "word_entropy", "top_word", "top_ten_words", "once_words",
    "alphabetic_words", "upper_words", "title_words", "digit_words", "odd_words", "short_words", "repeated_neighbours", "repeated_pairs", "top_pair", "repeated_fives",
    "lines", "line_length", "repeated_lines", "short_lines", "ended_lines", "marked_lines", "blank_lines", "sentences", "sentence_length", "compressed", "compressed_start", "links", "pipes", "tags",
)
_STOPS = ".,;:!?"
_ODD = re.compile(r"[^\w\s.,;:!?'\"()\-’“”«»¿¡…–—]")
_CHUNK = 65_536


def statistics(text: str) -> list[float]:
    """The features of a whole text; without characters or words the shares are 0."""
    chars = Counter(text)
    n = max(1, len(text))
    kind = {"alpha": 0, "digit": 0, "upper": 0, "space": 0, "stop": 0, "symbol": 0, "wide": 0}
    for c, k in chars.items():
        kind["alpha"] += k * c.isalpha()
        kind["digit"] += k * c.isdigit()
        kind["upper"] += k * c.isupper()
        kind["space"] += k * c.isspace()
        kind["stop"] += k * (c in _STOPS)
        kind["symbol"] += k * bool(_ODD.match(c))
        kind["wide"] += k * (ord(c) > 127)
    words = text.split()
    counts, m = Counter(words), max(1, len(words))
    lengths = [(len(w), k) for w, k in counts.items()]
    mean = sum(x * k for x, k in lengths) / m
    common = [k for _, k in counts.most_common(10)]
    pairs = Counter(zip(words, words[1:]))
    fives = max(0, len(words) - 4)
    lines = text.split("\n")
    full = [x.strip() for x in lines if x.strip()]
    rows, k = Counter(full), max(1, len(full))
    raw = text.encode(errors="replace")
    packer, packed = zlib.compressobj(1), 0
    for i in range(0, len(raw), _CHUNK):
        packed += len(packer.compress(raw[i : i + _CHUNK]))
    packed += len(packer.flush())
    of = lambda test: sum(c for w, c in counts.items() if test(w)) / m
    entropy = lambda table, total: -sum(c / total * math.log2(c / total) for c in table.values())
    ends = sum(chars.get(c, 0) for c in ".!?")
    return [
        math.log1p(len(text)), kind["alpha"] / n, kind["digit"] / n, kind["upper"] / max(1, kind["alpha"]), kind["space"] / n, chars.get("\n", 0) / n, kind["stop"] / n, kind["symbol"] / n,
        kind["wide"] / n, entropy(chars, n), max(chars.values(), default=0) / n, len(chars) / math.log2(n + 1),
        math.log1p(len(words)), mean, math.sqrt(max(0.0, sum(x * x * c for x, c in lengths) / m - mean * mean)), math.log1p(max((x for x, _ in lengths), default=0)),
        len(counts) / m, entropy(counts, m) / math.log2(m + 1), (common or [0])[0] / m, sum(common) / m, sum(c == 1 for c in counts.values()) / m,
        of(str.isalpha), of(lambda w: len(w) > 1 and w.isupper()), of(str.istitle), of(lambda w: any(map(str.isdigit, w))), of(_ODD.search), of(lambda w: len(w) < 4),
        sum(a == b for a, b in zip(words, words[1:])) / m, 1 - len(pairs) / max(1, len(words) - 1), max(pairs.values(), default=0) / m,
        1 - len(set(zip(*[words[i:] for i in range(5)]))) / fives if fives else 0.0,
        math.log1p(len(lines)), math.log1p(sum(map(len, full)) / k), 1 - len(rows) / k, sum(c for x, c in rows.items() if len(x) < 40) / k, sum(c for x, c in rows.items() if x[-1] in ".!?\"'”") / k,
        sum(c for x, c in rows.items() if not x[0].isalnum()) / k, (len(lines) - len(full)) / len(lines), ends / m, m / (ends + 1), packed / max(1, len(raw)),
        len(zlib.compress(raw[:_CHUNK], 1)) / max(1, len(raw[:_CHUNK])), (text.count("http") + text.count("www.")) / m, text.count("|") / m, text.count("<") / m,
    ]


@dataclass
class Trees:
    """All trees in flat arrays. A leaf leads to itself; ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of the rows of ``x``, all trees walked at once."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


class _Grower:
    """Grows one tree after the other over binned rows, and lays them out."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], leaves: int, depth: int, ridge: float, least: float):
        self.bins, self.edges, self.leaves, self.depth, self.ridge, self.least = bins, edges, leaves, depth, ridge, least
        self.width = max((len(e) for e in edges), default=0) + 1
        self.offset = np.arange(bins.shape[1]) * self.width
        self.nodes: list[list[float]] = []  # feature, threshold, left, right, value
        self.roots: list[int] = []

    def _histogram(self, rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = (self.bins[rows] + self.offset).ravel()
        size, f = self.width * len(self.offset), len(self.offset)
        sums = [np.bincount(places, np.repeat(v[rows], f), size).reshape(f, self.width) for v in (gradient, weight)]
        return sums[0], sums[1]

    def _best(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, bin): rows up to the bin go left."""
        gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
        all_g, all_h = g[0].sum(), h[0].sum()
        gr, hr = all_g - gl, all_h - hl
        gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - all_g**2 / (all_h + self.ridge)
        gain[(hl < self.least) | (hr < self.least)] = -1.0
        best = int(gain.argmax())
        return float(gain.flat[best]), best // gain.shape[1], best % gain.shape[1]

    def add(self, gradient: np.ndarray, weight: np.ndarray, rate: float) -> np.ndarray:
        """Grows a tree, best split first; returns what it adds to each row."""
        added, start = np.zeros(len(gradient)), len(self.nodes)
        self.roots.append(start)
        self.nodes.append([0, 0.0, start, start, 0.0])
        everything = np.arange(len(gradient))
        hist = self._histogram(everything, gradient, weight)
        open_nodes = [(start, everything, hist, 0, self._best(*hist))]
        done = []
        while open_nodes and len(open_nodes) + len(done) < self.leaves:
            pick = max(range(len(open_nodes)), key=lambda i: open_nodes[i][4][0])
            node, rows, hist, level, (gain, feature, split) = open_nodes.pop(pick)
            if gain <= 1e-9 or level >= self.depth:
                done.append((node, rows))
                continue
            goes_left = self.bins[rows, feature] <= split
            parts = [rows[goes_left], rows[~goes_left]]
            small = int(len(parts[1]) < len(parts[0]))
            one = self._histogram(parts[small], gradient, weight)
            both = [one, (hist[0] - one[0], hist[1] - one[1])]
            both = both if small == 0 else both[::-1]
            kids = [len(self.nodes), len(self.nodes) + 1]
            self.nodes[node] = [feature, float(self.edges[feature][split]), *kids, 0.0]
            for kid, part, h in zip(kids, parts, both):
                self.nodes.append([0, 0.0, kid, kid, 0.0])
                open_nodes.append((kid, part, h, level + 1, self._best(*h)))
        for node, rows in [*done, *[(o[0], o[1]) for o in open_nodes]]:
            value = -rate * gradient[rows].sum() / (weight[rows].sum() + self.ridge)
            self.nodes[node][4] = value
            added[rows] = value
        return added

    def trees(self, base: float, count: int) -> Trees:
        roots = np.array(self.roots[:count], dtype=np.int64)
        table = np.array(self.nodes[: self.roots[count] if count < len(self.roots) else len(self.nodes)] or [[0, 0, 0, 0, 0]])
        whole = lambda i: table[:, i].astype(np.int64)
        return Trees(whole(0), table[:, 1], whole(2), whole(3), table[:, 4], roots, self.depth, base)


def grow(x: np.ndarray, y: np.ndarray, check: np.ndarray, max_trees: int = 150, rate: float = 0.1, leaves: int = 12, depth: int = 5, max_bins: int = 64, ridge: float = 1.0, least: float = 2.0, patience: int = 20) -> Trees:
    """Boosts trees on the rows that ``check`` doesn't mark; those it marks tell after how many trees to stop.

    Bins end at quantiles of the values. Rows of one class only give a model without trees, the base rate.
    """
    fit = ~check if 0 < check.sum() < len(check) and 0 < y[~check].sum() < (~check).sum() else np.ones(len(y), dtype=bool)
    ones = float(y[fit].sum())
    base = math.log((ones + 0.5) / (fit.sum() - ones + 0.5))
    none = Trees(*[np.zeros(1, dtype=t) for t in (np.int64, float, np.int64, np.int64, float)], np.zeros(0, dtype=np.int64), 0, base)
    if not len(y) or ones in (0.0, float(fit.sum())):
        return none
    edges = [np.unique(np.quantile(x[fit, f], np.linspace(0, 1, max_bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[fit, f], side="left") for f, e in enumerate(edges)], 1)
    grower = _Grower(bins, edges, leaves, depth, ridge, least)
    target, margin = y[fit].astype(float), np.full(int(fit.sum()), base)
    loss_at: list[float] = []
    held = np.full(int(check.sum()), base)
    for i in range(max_trees):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + grower.add(p - target, p * (1 - p), rate)
        if fit.all():
            continue
        one = grower.trees(0.0, i + 1)
        held = held + Trees(one.feature, one.threshold, one.left, one.right, one.value, one.roots[-1:], depth, 0.0).margins(x[check])
        loss_at.append(float((np.logaddexp(0, held) - y[check] * held).mean()))
        if i - int(np.argmin(loss_at)) >= patience:
            break
    return grower.trees(base, int(np.argmin(loss_at)) + 1 if loss_at else max_trees)


_ROW = ", ".join(f"{f} double" for f in FEATURES)


def labelled_statistics(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_class: int) -> pd.DataFrame:
    """``doc_id, label, fold`` and the features of ``rows_per_class`` labelled rows of each class at most, by the order of a hash of their ids.

    Of rows that share one of two minima over the hashes of three-word runs, one is taken: one text copied often must not decide. Null ids and labels aren't taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("label")).distinct()
    taken = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for k in (0, 1)]
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            marks = [_sketch(t) for t in texts]
            table = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("label"), *[pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)], *[pa.array(table[:, i]) for i in range(len(FEATURES))]],
                ["doc_id", "label", "m0", "m1", *FEATURES],
            )

    rows = cut(rows.select("doc_id", "label", "text").mapInArrow(measured, f"doc_id long, label int, m0 long, m1 long, {_ROW}"), "quality_sample")
    for mark in ("m0", "m1"):
        others = [c for c in rows.columns if c != mark]
        rows = rows.groupBy(mark).agg(F.min_by(F.struct(*others), F.struct(F.xxhash64("doc_id"), "doc_id", "label")).alias("row")).select(mark, "row.*")
    table = rows.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5).drop("m0", "m1").toPandas()  # 2 * rows_per_class rows of numbers at most
    return table.sort_values(["doc_id", "label"], ignore_index=True)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows_per_class: int = 20_000, **options) -> Trees:
    """Trees over the statistics of a bounded sample: ``rows_per_class`` labelled rows of each class at most.

    Four fifths of the sample grow trees, one fifth tells when to stop. ``options`` go to :func:`grow`.
    """
    table = labelled_statistics(docs, labels, label_col, rows_per_class)
    return grow(table[list(FEATURES)].to_numpy(dtype=float).reshape(len(table), len(FEATURES)), table["label"].to_numpy(dtype=int), (table["fold"] == 4).to_numpy(dtype=bool), **options)


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, score, predicted`` of every row; whole texts are read, a null text is an empty one. The score is taken where the row is read."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(FEATURES))
            p = model.probabilities(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(scored, "doc_id long, score double, predicted int")


def held_out(column: str = "doc_id"):
    """The rows that no model learns from: a third of the ids, by their CRC."""
    return F.crc32(F.col(column).cast("string")) % 3 == 1


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``, by a model of the labels outside the held-out third.

    One row per row of ``docs``, null and repeated ids included (a null id is not held out and never learned from). Without labels of both classes every row gets
    the base rate. Language, source, ids and labels are no features; further columns aren't read.
    """
    model = train(docs, labels.where(~held_out()), **options)
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """``docs`` with all its columns, without the texts whose score is under ``least``."""
    model = train(docs, labels.where(~held_out()), **options)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probabilities(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return docs.where(quality(text_or_empty()) >= least)
