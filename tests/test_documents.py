import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filigraph.operators import chunking, extraction, sections
from filigraph.operators.lexicon import Lexicon


def frame(spark, *texts):
    return spark.createDataFrame([(f"T{i}", t) for i, t in enumerate(texts)], "ticker string, text string")


@pytest.mark.parametrize("n, spans", [(0, []), (1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 10), (7, 11)]), (17, [(0, 10), (7, 17)]), (18, [(0, 10), (7, 17), (14, 18)])])
def test_chunk_spans(spark, n, spans):
    rows = chunking.chunk(frame(spark, " ".join(f"w{i}" for i in range(n))), size=10, overlap=3).orderBy("start_word").collect()
    assert [(r["start_word"], r["end_word"]) for r in rows] == spans
    assert [r["chunk_id"] for r in rows] == [f"T0_chunk_{i:04d}" for i in range(len(spans))]
    assert all(r["page_estimate"] == r["start_word"] // 250 + 1 and r["section"] == "Item 1" for r in rows)


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunking.chunk(frame(spark, "a"), size=5, overlap=5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 90), st.integers(1, 20), st.data())
def test_chunks_rebuild_the_text(spark, n, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    words = [f"w{i}" for i in range(n)]
    rows = chunking.chunk(frame(spark, "\n".join(words)), size=size, overlap=overlap).orderBy("start_word").collect()
    rebuilt = []
    for r in rows:
        rebuilt = rebuilt[: r["start_word"]] + r["text"].split(" ")
    assert rebuilt == words


def test_explore(spark):
    chunks = chunking.chunk(frame(spark, "Alpha beta", None, "gamma"))
    assert [r["ticker"] for r in chunking.explore(chunks, "ALPHA|zeta").collect()] == ["T0"]
    assert chunking.explore_counts(chunks, "a").first().asDict() == {"shown": 2, "total": 2, "last_page": 2}
    assert chunking.explore(chunks, None, (2, 3)).count() == 0


def test_section_by_preference_and_caps(spark):
    head, tail = "Item 1. Business\nTable of Contents\n" + "x" * 120, "\nItem 1A. Risk Factors\nmore"
    cut = lambda t: frame(spark, t).select(sections.section_text(F.col("text")).alias("r")).first()["r"]
    assert cut("intro\n" + head + tail) == "Item 1. Business\n\n" + "x" * 120
    assert cut("no header " * 6000) == ("no header " * 5000).strip()
    assert len(cut("ITEM 1 - BUSINESS " + "y" * 200_000)) == 100_000
    second_first = "\nPART I\nItem 1 a\nITEM 1. BUSINESS b" + "z" * 100
    assert cut(second_first).startswith("ITEM 1. BUSINESS")


TEXT = (
    "Our mission is to help every person. We expand into new regions with care for all people. Innovation drives research and development at scale here. "
    "We launched our Prime Delivery Membership, and introduced the Best Value Program. The supply chain and logistics rely on cloud services. "
    "Inflation and regulation matter. Competition is strong. Cyber risks exist. The workforce is large"
)


def record(spark, text, lexicon=None):
    return extraction.extract(frame(spark, text), lexicon).first()


def test_rules(spark):
    r = record(spark, TEXT)
    assert r["Mission"]["text"] == "help every person."
    assert [o["objective_type"] for o in r["StrategicObjective"]] == ["growth", "innovation"]
    assert r["StrategicObjective"][0]["text"] == "We expand into new regions with care for all people."
    assert [c["name"] for c in r["Capability"]] == ["supply chain", "logistics", "cloud", "research and development"]
    assert [i["name"] for i in r["Initiative"]] == ["Prime Delivery Membership", "Best Value Program", "The supply chain and logistics rely on cloud service"]
    assert [x["risk_category"] for x in r["RiskTheme"]] == ["macro", "regulatory", "competitive", "supply_chain", "technology"]
    assert ["Capability", "supportsObjective", "We expand into new regions with care for all peopl"] in r["Edges"]


def test_mission_fallback_and_short_texts(spark):
    fallback = record(spark, "Short. " + "A sentence that is certainly longer than forty characters. " * 3)
    assert fallback["Mission"]["text"] == "A sentence that is certainly longer than forty characters"
    assert extraction.extract(frame(spark, "tiny", None)).count() == 0


def test_upper_case_keyword_never_matches(spark):
    assert record(spark, "ESG ESG " * 30 + ".", Lexicon(objectives={"s": ("ESG",)}))["StrategicObjective"] == []


def test_sentence_without_stop_takes_201_characters(spark):
    r = record(spark, "a" * 30 + " grow " + "b" * 400, Lexicon(objectives={"g": ("grow",)}))
    assert r["StrategicObjective"][0]["text"] == "a" * 30 + " grow " + "b" * 196


def test_nodes_and_edges(spark):
    records = extraction.extract(frame(spark, TEXT))
    nodes, edges = extraction.nodes(records).collect(), extraction.edges(records).collect()
    ids = {n["id"] for n in nodes}
    assert {"Company:T0", "Mission:T0:mission", "Capability:T0:supply-chain", "RiskTheme:T0:inflation"} <= ids
    assert all(e["src"] in ids and e["dst"] in ids for e in edges)
    links = [e for e in edges if e["rel"] == "supportsObjective"]
    assert len(links) == 4 and {e["dst"] for e in links} == {"StrategicObjective:T0:we-expand-into-new-regions-with-care-for-all-people"}


def test_model_record_goes_first(spark):
    answer = 'Sure: {"Mission": {"text": "from the model"}, "Capability": [{"name": "robots"}]} done'
    rows = frame(spark, TEXT, TEXT).withColumn("record", F.when(F.col("ticker") == "T0", extraction.parse_record(F.lit(answer))))
    got = {r["Company"]["ticker"]: r for r in extraction.extract(rows).collect()}
    assert got["T0"]["Mission"]["text"] == "from the model" and got["T1"]["Mission"]["text"] == "help every person."
