import pytest

from filigraph.operators import compare, graph as graphs, ontology
from filigraph.operators.graph import Graph

NODES = [
    ("C:a", "Company", "Anna", None, 0), ("M:a", "Mission", None, "serve all", 1), ("R:1", "RiskTheme", "inflation", None, 2), ("K:1", "Capability", "supply chain", None, 3),
    ("O:1", "StrategicObjective", None, "grow the market", 4), ("C:b", "Company", None, None, 5),
]
EDGES = [("C:a", "M:a", "hasMission", 0), ("C:a", "R:1", "old", 1), ("C:a", "K:1", "builds", 2), ("K:1", "O:1", "supports", 3), ("O:1", "C:a", "back", 4), ("O:1", "K:1", "loop", 5), ("C:a", "R:1", "exposedTo", 6), ("R:1", "X", "to", 7)]


@pytest.fixture(scope="module")
def g(spark) -> Graph:
    nodes = spark.createDataFrame(NODES, "id string, label string, name string, text string, ord bigint")
    return graphs.load(nodes, spark.createDataFrame(EDGES, "src string, dst string, rel string, ord bigint"))


def seeds(spark, *ids, topic=None):
    return spark.createDataFrame([(i, topic) for i in ids], "seed string, topic string")


def test_load_merges_and_adds_ends(g):
    assert g.edges.count() == 7 and g.nodes.where("id = 'X'").count() == 1
    edge = g.edges.where("dst = 'R:1'").first()
    assert (edge["rel"], edge["ord"]) == ("exposedTo", 1)


def test_repeated_node_keeps_last_filled(spark):
    nodes = spark.createDataFrame([("n", "A", "x", 0), ("n", None, "y", 1), ("n", "B", " ", 2)], "id string, label string, name string, ord bigint")
    got = graphs.load(nodes, spark.createDataFrame([], "src string, dst string, rel string, ord bigint")).nodes.first()
    assert (got["label"], got["name"], got["ord"]) == ("B", "y", 0)


def test_search_order_and_scores(spark, g):
    rows = graphs.search(g, seeds(spark, "C:a", topic="supply boats"), 10).orderBy("place").collect()
    assert [(r["node_id"], r["score"]) for r in rows] == [("K:1", 0.7), ("M:a", 0.5), ("R:1", 0.5), ("X", 0.4), ("O:1", 0.4)]
    assert rows[-1]["path"] == "C:a →[builds]→ Capability →[supports]→ StrategicObjective" and rows[3]["label"] == "Unknown"
    assert graphs.search(g, seeds(spark, "C:a", topic="supply chain"), 1).first()["score"] == 0.9
    assert graphs.search(g, seeds(spark, "nobody"), 5).count() == 0


def test_paths_never_return(spark, g):
    rows = graphs.paths(g, seeds(spark, "C:a").select("seed")).collect()
    texts = sorted(r["path"] for r in rows)
    assert len(rows) == 5 and "C:a → Capability → StrategicObjective" in texts
    assert not any("Capability → StrategicObjective → " in t for t in texts)


def test_overview_counts(spark, g):
    rows = {r["ticker"]: r for r in graphs.overview(g, seeds(spark, "C:a", "C:b", "C:none").select("seed")).collect()}
    assert rows["a"]["mission"] == "serve all" and rows["a"]["capabilities"] == ["supply chain"] and (rows["a"]["nodes"], rows["a"]["edges"]) == (6, 5)
    assert (rows["b"]["nodes"], rows["b"]["edges"], rows["b"]["name"]) == (1, 0, "b")
    assert (rows["none"]["nodes"], rows["none"]["edges"], rows["none"]["name"]) == (0, 0, "")
    near = {r["seed"]: (r["nodes"], r["edges"]) for r in graphs.near_counts(g, seeds(spark, "C:a").select("seed")).collect()}
    assert near == {"C:a": (4, 3)}


def test_compare(spark, g):
    row = graphs.compare(g, "C:a", "C:b").first()
    assert row["company1"]["name"] == "Anna" and len(row["dimensions"]) == 5


def test_induced_keeps_edges_between(spark, g):
    inside, edges = graphs.induced(g, seeds(spark, "C:a").select("seed"))
    assert inside.count() == 6 and edges.count() == 7


def test_views(spark, g):
    row = graphs.node_view(g, g.nodes.where("id = 'K:1'"), {"Capability": "#fff"}, {}).first()
    assert row["display"] == "Supply Chain" and row["color"] == "#fff" and row["size"] == 22
    assert row["tooltip"].split("\n")[4:] == ["  IN:  [Company] --builds--> this", "  IN:  [StrategicObjective] --loop--> this", "  OUT: this --supports--> [StrategicObjective]"]
    assert graphs.edge_view(g).where("predicate = 'exposedTo'").first()["tooltip"].endswith("[RiskTheme] Inflation.")


def test_distance_selection_and_filters(spark, g):
    found = {r["id"]: r["distance"] for r in graphs.distance_classes(g, seeds(spark, "R:1").select("seed")).collect()}
    assert found == {"R:1": 0, "C:a": 1, "X": 1, "M:a": 2, "K:1": 2, "O:1": 2}
    assert graphs.select_nodes(g, g.nodes.where("id = 'X'")).where("shown").count() == 1
    assert graphs.select_nodes(g, g.nodes.where("false")).where("shown").count() == 7
    assert sorted(r["id"] for r in graphs.filter_by_property(g, "edge", "rel", ["builds"]).collect()) == ["C:a", "K:1"]


def test_ontology(spark, g):
    rules = spark.createDataFrame([("builds", "Company", "Capability"), ("hasMission", "Mission", "Mission"), ("to", "RiskTheme", "Company")], "edge string, domain string, range string")
    faults = {r["rel"]: r["fault"] for r in ontology.violations(g, rules).collect()}
    assert faults["hasMission"] == "domain" and faults["to"] == "dangling end" and faults["loop"] == "undeclared relation" and "builds" not in faults


def test_scorecards(spark, g):
    scores = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 1)], "ticker string, dimension string, score int")
    companies = spark.createDataFrame([("a", "Good"), ("b", "Bad")], "ticker string, category string")
    wide = compare.heatmap(companies, scores, ["y"], ["x", "y"]).collect()
    assert [(r["ticker"], r["total"], r["y"]) for r in wide] == [("a", 4, 1), ("b", 1, 0)]
    assert compare.heatmap(companies, scores, ["y"], ["x", "y"], ["Bad"]).count() == 1
    assert compare.in_categories(companies, []).count() == 0 and compare.heatmap(companies, scores, [], ["x"]).count() == 0
    percent = compare.percentages(compare.dense(companies, scores, ["x", "y"]), ["x", "y"])
    assert {r["ticker"]: r["pct"] for r in percent.collect()} == {"a": 67, "b": 17}
    assert compare.winner(percent, "a", "b").first()["winner"] == "a"
    rows = compare.head_to_head(scores, ["x", "y"], "b", "a").collect()
    assert [(r["score1"], r["better"]) for r in rows] == [("🟡 1/3", "a →"), ("⬜ 0/3", "a →")]
    chain = {r["step"]: r["value"] for r in compare.evidence_chain(g, seeds(spark, "C:a").select("seed")).collect()}
    assert chain == {1: "—", 2: "—", 3: "Supply Chain", 4: "—", 5: "Inflation"}
    assert compare.layout(3, 2) == (390, 400)
