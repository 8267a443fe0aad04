from filigraph.llm.toxicity import Model

BAD = [f"bad{i}" for i in range(8)]
PASSAGE = " ".join(BAD)


def model():
    return Model({w: 2.0 for w in BAD}, drift=-0.05, rate=1.0, ln_k=-2.0)


def filler(n):
    return " ".join(f"w{i % 89}" for i in range(n))


def test_passage_after_scattered_words():
    text = " ".join(f"{w} {filler(500)}" for w in BAD) + " " + PASSAGE + " " + filler(500)
    evidence, spans = model().evidence(text)
    assert evidence > 0 and [text[a:b] for _, a, b in spans] == [PASSAGE]


def test_same_passage_twice():
    text = f"{PASSAGE} {filler(600)} {PASSAGE}"
    assert [text[a:b] for _, a, b in model().evidence(text)[1]] == [PASSAGE, PASSAGE]


def test_near_repeats_are_no_new_evidence():
    assert model().evidence(" ".join([BAD[0]] * 50) + " " + filler(100))[1] == []
    words = " ".join(f"{w} w1 w2" for w in BAD)
    (s, a, b), = model().evidence(f"{words} {PASSAGE} {filler(300)}")[1]
    assert s > 7 * 2.0
