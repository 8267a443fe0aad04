"""The toxicity query against versions of its own: token weights, passages and scores by plain loops."""

import math
import re
import zlib

import pytest

from filigraph.llm import toxicity


def plain_tokens(text):
    words = set(re.findall(r"\w+", text.lower()))
    return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}


def plain_weights(rows, prior_share=0.05, caution=0.8):
    """{token: weight} of (text, label) rows, from how many texts of each class have a token."""
    toxic_texts, clean_texts = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    counts = {}
    for text, y in rows:
        for t in plain_tokens(text):
            counts.setdefault(t, [0, 0])[y] += 1
    counts = {t: c for t, c in counts.items() if sum(c) >= 3}
    least = caution * math.sqrt(2 * math.log(max(2, len(counts))))
    prior = prior_share * (toxic_texts + clean_texts)
    out, texts = {}, {}
    for token, (clean, toxic) in counts.items():
        share = (toxic + clean) / (toxic_texts + clean_texts)
        a, b = toxic + prior * share, clean + prior * share
        delta = math.log(a / (toxic_texts + prior - a + 1)) - math.log(b / (clean_texts + prior - b + 1))
        sd = math.sqrt(1 / a + 1 / b)
        weight = delta - math.copysign(sd, delta)
        if abs(delta) >= least * sd and abs(weight) >= math.log(2):
            out[token], texts[token] = weight, max(toxic, clean)
    alone = {}  # the beginning of a word that makes up most of its texts says nothing more
    for token in out:
        if not token.endswith("*"):
            for n in (4, 5, 6):
                if len(token) > n:
                    alone[token[:n] + "*"] = max(texts[token], alone.get(token[:n] + "*", 0))
    return {t: w for t, w in out.items() if alone.get(t, 0) < 0.7 * texts[t]}


def plain_probability(model, text):
    words = [w.lower() for w in re.findall(r"\w+", text)]
    scores, counted = [], {}
    for i, w in enumerate(words):
        s = model.weights.get(w)
        for n in (6, 5, 4):
            if s is None and len(w) > n:
                s = model.weights.get(w[:n] + "*")
        s = model.drift if s is None else s
        if s > 0:
            if w in counted and (i - counted[w]) * -model.drift < s:
                s = model.drift
            else:
                counted[w] = i
        scores.append(s)
    limit = model.ln_k + math.log(len(words)) if words else 0
    evidence = sum(model.rate * s - limit for s, _, _ in plain_segments(scores) if model.rate * s > limit)
    z = model.slope * math.log1p(evidence) + model.offset
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def plain_segments(scores):
    """Maximal segments by their definition: the best one (of equals the shortest), then both sides of it."""
    if not any(s > 0 for s in scores):
        return []
    sums = [0.0]
    for s in scores:
        sums.append(sums[-1] + s)
    best = max(((sums[b] - sums[a], a - b, a, b) for a in range(len(scores)) if scores[a] > 0 for b in range(a + 1, len(scores) + 1) if scores[b - 1] > 0), key=lambda x: (round(x[0], 9), x[1]))
    _, _, a, b = best
    shift = [(s, x + b, y + b) for s, x, y in plain_segments(scores[b:])]
    return plain_segments(scores[:a]) + [(best[0], a, b)] + shift


def test_weights_equal_plain_ones(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    sample = toxicity.labelled_sample(docs, labels, "toxic", 20_000)
    rows = [(r["text"], r["label"]) for r in sample.collect()]
    toxic = sum(y for _, y in rows)
    got = toxicity.log_odds(toxicity._counts(sample), toxic, len(rows) - toxic, 0.05, 0.8, 50_000)
    want = plain_weights(rows)
    assert len(want) > 5 and got == {t: pytest.approx(w) for t, w in want.items()}


def test_scores_equal_plain_ones(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert set(rows) == set(texts)
    short = [i for i, t in texts.items() if len(t) < 4000]
    assert len(short) > 100
    for i in short:
        want = plain_probability(model, texts[i])
        assert rows[i]["score"] == pytest.approx(want) and rows[i]["predicted"] == int(want >= 0.5) and rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_every_repeated_passage_is_found():
    """Two words at both ends of a long text are two passages."""
    model = toxicity.Model({"bad": 4.0, "awful": 4.0}, -0.05, rate=1.0, ln_k=-3.0)
    text = "bad and awful " + "calm words here " * 400 + "bad and awful"
    assert [text[a:b] for _, a, b in model.evidence(text)[1]] == ["bad and awful", "bad and awful"]
