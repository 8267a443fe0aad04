import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from filigraph.llm import pieces, token_counts

ODD = [
    "", " ", "  ", "a ", "\n", " \n ", "▁", "x▁▁y", "日本語 テスト 😀", "  tab\tand  double   spaces", "=" * 200, "a" * 100 + " " * 40 + "b", "<s> </s> <unk> <0x0A>", "١٢٣ 123456", "é" * 50,
    "\x00\x01", "-" * 80 + "x", "ﬁ½²³", "foo\r\nbar baz　qux", "a <|endoftext|> b", "don't I'LL  x \n\n y\t z  ", "naïve ×÷ 1²3 ½ ª",
]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_documents_encode_as_the_library(spark, sf, model, library):
    texts = ODD + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text, (ids, decoded) in zip(texts, model.coded(texts)):
        want = library.encode(text) + [library.eos_id()]
        assert [int(i) for i in ids.split()] == want and decoded == library.decode(want)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeth ▁\nn.1é語😀-=\t", max_size=40))
def test_any_text(model, library, text):
    assert model.encode(text) == library.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decoding_any_ids(model, library, ids):
    assert model.decode(ids) == library.decode(ids)


def test_both_agendas_agree(model):
    for unit in ("▁international", "a" * 39, "▁" * 17 + "the", "▁straightforwardly"):
        assert model._ids(model._long_agenda(unit)) == model._agenda([unit])[0]


def test_full_cache_changes_nothing(library):
    small = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"), cache_units=10)
    texts = [f"word{i} the and of {i}" for i in range(50)]
    got = [ids for t in texts for ids, _ in small.coded([t])]
    assert got == [" ".join(map(str, library.encode(t) + [2])) for t in texts]


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.PieceModel(str(tmp_path / "none.model"))


def test_piece_query(spark, library):
    docs = spark.createDataFrame([(1, None, 5), (2, "the cat", 5), (2, "the cat", 5), (None, "x " * 60_000, 5)], "doc_id long, text string, n_tokens int")
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.round_trip(docs, path).collect()
    assert len(rows) == 4
    for r in rows:
        text = {1: "", 2: "the cat", None: "x " * 60_000}[r["doc_id"]]
        ids = library.encode(text) + [2]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.round_trip(docs.where("false"), path).count() == 0
    assert pieces.encode_column(docs, path).where("doc_id = 2").first()["ids"] == library.encode("the cat") + [2]


def test_counter_equals_library(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, plain = token_counts.Counter(path, remembered=500), Tokenizer.from_file(path)
    texts = ODD + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert counter.counts(texts) == [len(e) for e in plain.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeS'tld 12²é\n\t.,-ÿ×<|endoftext|> ", max_size=40))
def test_counter_any_text(text):
    counter = token_counts.counter_at(public_tokenizers.path("byte_bpe_50k.json"))
    assert counter.counts([text]) == counter.whole([text])


def test_other_vocabularies_are_counted_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = token_counts.Counter(path)
    assert not counter.by_word and counter.counts(["Hello  World"]) == [len(Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False))]


def test_cache_encodes_only_misses(spark, tmp_path, monkeypatch):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (None, "three"), (4, None), (4, None), (5, "x" * 5000)], "doc_id long, text string").selectExpr("*", "1 AS digest")
    stored = lambda: token_counts.stored_counts(spark, cache, token_counts.tokenizer_digest(path))
    assert stored().count() == 0
    first = token_counts.count_tokens(docs.where("doc_id < 4"), path, cache, limit=1).collect()
    assert {(r["doc_id"], r["n_tokens"], r["over_limit"], r["n_bytes"]) for r in first} == {(1, 2, True, 7), (2, 2, True, 7)} and stored().count() == 1
    seen = []
    encode = token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda texts, p: encode(seen.append(sorted(r["text"][:5] for r in texts.collect())) or texts, p))
    rows = token_counts.count_tokens(docs, path, cache).collect()
    assert sorted({t for t in seen[0]}) == ["", "three", "xxxxx"] and len(rows) == 6 and stored().count() == 4
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 4} == {0}
    seen.clear()
    assert token_counts.count_tokens(docs, path, cache).count() == 6 and seen == [[]]
    assert token_counts.count_tokens(docs.where("false"), path, f"file://{tmp_path}/other").count() == 0


@pytest.mark.parametrize("small_rows", [0, 3, 1000])
def test_each_missing_text_is_encoded_once(spark, tmp_path, monkeypatch, small_rows):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    rows = [(None, "copied text")] * 500 + [(7, "twice"), (7, "twice"), (8, None), (8, ""), (9, "alone"), (10, "stored"), (10, "other of one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS single").repartition(5)
    seen, encode, choose = [], token_counts.encode_misses, token_counts.texts_of_misses
    monkeypatch.setattr(token_counts, "texts_of_misses", lambda t, d, s: choose(t, d, s, small_rows))
    monkeypatch.setattr(token_counts, "encode_misses", lambda texts, p: encode(seen.append(sorted(r["text"] for r in texts.collect())) or texts, p))
    assert token_counts.count_tokens(docs.where("text = 'stored'"), path, cache).count() == 1
    out = token_counts.count_tokens(docs, path, cache).collect()
    assert seen == [["stored"], ["", "alone", "copied text", "other of one id", "twice"]] and len(out) == len(rows)
    plain = Tokenizer.from_file(path)
    want = sorted(repr((i, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False)))) for i, t in rows)
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in out) == want
