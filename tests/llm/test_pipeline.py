import corpus_pipeline
from filigraph.llm import mixing, toxicity
from filigraph.llm.queries import queries
from tests.llm.test_near_copies import brute_kept


def test_stages_against_brute_force(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "pieces"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    verdict = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, labels).collect()}
    first = stage["toxicity"](spark, docs, sf).cache()
    assert {r["doc_id"] for r in first.collect()} == {i for i, p in verdict.items() if not p} and first.columns == docs.columns
    second = stage["exact_dedup"](spark, first, sf).cache()
    last = {}
    for r in first.collect():
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", -1))
    assert {r["doc_id"] for r in second.collect()} == set(last.values())
    third = stage["simhash"](spark, second, sf).cache()
    assert {r["doc_id"] for r in third.collect()} == brute_kept({r["doc_id"]: r["text"] or "" for r in second.collect()}) and third.columns == docs.columns
    fourth = stage["mixing"](spark, third, sf).cache()
    times = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in mixing.mix(third).collect()}
    got = {}
    for r in fourth.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in times.items() if n}
    fifth = stage["pieces"](spark, fourth, sf)
    assert fifth.count() == fourth.count() and set(fifth.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, fifth.collect()))


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(queries()) | {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
