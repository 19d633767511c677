"""A small graph with the cases that star-schema tables lack, and the tools on it."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import tools as T
from quillgraph.plans.ontology import Ontology, Relation, at_least

RELATIONS = (
    Relation("within", "contains", "in"), Relation("parts", "contains", "out"), Relation("ruler", "ruledBy", "out"), Relation("members", "memberOf", "in"),
    Relation("capital", None, "derived", "capital", "current"), Relation("former_capitals", None, "derived", "capital", "former"),
)
ONTO = Ontology({"Place": None, "Nation": "Place", "City": "Place", "Lake": "Place", "River": "Place", "Person": None, "Group": None, "House": "Group"}, RELATIONS, (), {"status": "status", "ruledBy": "ruledBy"})


@pytest.fixture(scope="module")
def graph(spark):
    places = {"land": ["Place"], "aland": ["Nation", "Place"], "amid": ["City", "Place"], "afar": ["City", "Place"], "bland": ["Nation", "Place"], "bold": ["City", "Place"], "brook": ["River", "Place"], "mere": ["Lake", "Place"]}
    labels = [("land", "Land"), ("aland", "Aland"), ("amid", "Amid"), ("afar", "Afar"), ("bland", "Bland"), ("bold", "Bold"), ("brook", "Brook"), ("mere", "Mere"), ("mere", "Great Mere"), ("king", "Karl"), ("house", "House Smith"), ("smith", "Anna"), ("twin1", "Twin"), ("twin2", "Twin")]
    types = [(s, t) for s, ts in places.items() for t in ts] + [("king", "Person"), ("smith", "Person"), ("house", "House"), ("house", "Group"), ("twin1", "Person"), ("twin2", "Person")]
    contains = [("land", "aland"), ("land", "hidden"), ("hidden", "mere"), ("aland", "amid"), ("aland", "afar"), ("land", "bland"), ("bland", "bold"), ("loop1", "loop2"), ("loop2", "loop1"), ("aland", "amid")]
    edges = [(a, "contains", b) for a, b in contains] + [("aland", "ruledBy", "king"), ("smith", "memberOf", "house"), ("twin1", "memberOf", "house"), ("twin2", "memberOf", "house"), ("bold", "capitalOf", "bland")]
    facts = [("amid", "capitalStatus", "current"), ("afar", "capitalStatus", "former"), ("afar", "capitalStatus", "lost"), ("bold", "capitalStatus", "former"), ("amid", "description", "The city on the long river of Aland, where the market is."), ("aland", "status", "Past"), ("mere", "depth", "9"), ("mere", "depth", "12")]
    mentions = [("amid", "b1", "9"), ("amid", "b1", "142"), ("amid", "b1", None), ("amid", "b2", "xii"), ("king", "b1", "3")]
    df = spark.createDataFrame
    g = G.Graph(
        df(labels, "s string, label string"), df([("king", "King Karl"), ("king", "The Red")], "s string, alias string"), df(types, "s string, type string"), df(edges, "s string, p string, o string").distinct(), df(facts, "s string, p string, value string"),
        df(mentions, "s string, book string, page string"), df([(s, b) for s, b, _ in mentions] + [("house", "b2")], "s string, book string").distinct(), df([("b1", "One", "5e", "canon"), ("b2", "Two", "3e", "kanon")], "book string, title string, edition string, canon_type string"), ONTO.type_dim(spark), ONTO.rel_dim(spark),
    )
    return g.with_closure()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_closure_with_a_cycle(graph):
    got = rows(graph.closure, "ancestor", "descendant", "depth")
    assert [x for x in got if x[0].startswith("loop")] == [("loop1", "loop1", 2), ("loop1", "loop2", 1), ("loop2", "loop1", 1), ("loop2", "loop2", 2)]
    assert ("land", "amid", 2) in got and ("land", "mere", 2) in got


def test_totals_count_entities_pages_names(graph):
    assert rows(G.relationship(graph, "memberOf", "in"), "s", "other") == [("house", "Anna"), ("house", "Twin")]
    assert rows(G.relationship_total(graph, "memberOf", "in"), "s", "total") == [("house", 3)]
    assert G.count_entities(graph, "Person").first()["total"] == 4


def test_provenance_needs_one_book(graph):
    assert rows(G.list_names(graph, "City", edition="5e", canon="canon"), "name") == [("Amid",)]
    assert rows(G.list_names(graph, "City", edition="5e", canon="kanon"), "name") == []
    assert rows(G.list_names(graph, "City", edition="3e"), "name") == [("Amid",)]


def test_filters(graph):
    assert rows(G.list_names(graph, "Nation", {"status": " past "}), "name") == [("Aland",)]
    assert rows(G.list_names(graph, "Nation", {"ruledBy": "KARL"}), "name") == [("Aland",)]
    assert rows(G.list_names(graph, "Nation", {"ruledBy": "KARL", "status": "present"}), "name") == []
    assert rows(G.search_by_property(graph, "Lake", "depth", "1", "contains"), "name") == [("Great Mere",), ("Mere",)]


def test_capitals(graph):
    got = rows(G.capitals(graph), "entity", "city", "status")
    assert [x for x in got if x[0] == "aland"] == [("aland", "afar", "former"), ("aland", "afar", "lost"), ("aland", "amid", "current")]
    assert ("bland", "bold", "former") in got and not [x for x in got if x[0] == "land"]  # nations lie between


def test_search(graph):
    found = G.by_relevance(G.search_entities(graph, "karl"), 5).collect()
    assert [(r["name"], r["score"], r["hit"]) for r in found] == [("Karl", 0, "Karl")]
    assert G.search_entities(graph, "the red").first()["hit"] == "The Red"
    assert [r["name"] for r in G.best_first(G.resolve(graph, "KING KARL")).withColumnRenamed("label", "name").collect()] == ["Karl"]
    hit = G.by_score(G.search_text(graph, "Where is the market of the river?"), 3).collect()
    assert [(r["name"], r["score"]) for r in hit] == [("Amid", 2)]


def test_sources_sort_pages_by_number(graph):
    got = {r["title"]: r["pages"] for r in G.sources(graph).where("s = 'amid'").collect()}
    assert [p for p in got["One"] if p] == ["9", "142"] and got["Two"] == ["xii"]
    assert rows(G.list_sources(graph), "title", "entities") == [("One", 2), ("Two", 2)]


@pytest.fixture(scope="module")
def tools(graph):
    return T.Tools(graph, ONTO)


def test_tools(tools):
    assert tools.list_names("City", limit=2) == {"total": 3, "offset": 0, "names": ["Afar", "Amid"], "count": 2, "truncated": True, "next_offset": 2, "hint": "ask again from next_offset"}
    assert "River" in tools.list_names("Rivers")["suggestions"] and "error" in tools.list_names("City", {"colour": "x"})
    assert tools.search_entities("king karl") == {"matches": [{"name": "Karl", "types": ["Person"], "matched_alias": "King Karl"}]}
    assert all("error" in x for x in (tools.search_entities("k"), tools.search_entities("karl", "Persn"), tools.search_text("ab"), tools.search_text("what is the"), tools.search_text("market", "Citty")))
    assert tools.get_relationships("aland", "capital")["names"] == ["Amid"] and tools.get_relationships("Aland", "former_capitals")["names"] == ["Afar"]
    assert tools.get_relationships("house smith", "members")["total"] == 3 and tools.get_relationships("aland", "ruler")["names"] == ["Karl"]
    assert "suggestions" in tools.get_relationships("aland", "rule") and "Karl" in tools.get_entity("Karl the Great")["suggestions"] + tools.get_entity("Kar")["suggestions"]
    assert tools.get_entity("mere")["facts"] == {"depth": ["12", "9"]} and tools.get_entity("mere")["types"] == ["Lake"]
    assert tools.get_entity("aland", "relationships")["relationships"]["ruler"] == [{"name": "Karl", "types": ["Person"]}]
    up = tools.get_location_hierarchy("amid")
    assert up["ancestors"] == ["Aland", "Land"] and up["children"] == []
    assert tools.get_location_hierarchy("land", "all")["total"] == 6  # entities: one of them has two names
    found = tools.get_sources(["amid", "nobody"], edition="5e")["entities"]
    assert [s["title"] for s in found[0]["sources"]] == ["One"] and "error" in found[1]
    assert tools.search_text("market river")["matches"][0]["sources"] and len(tools.list_sources()["sources"]) == 2 and "Place" in tools.describe_schema()["types"]


def test_unlabelled_step_hides_ancestors(graph):
    assert [r["ancestor"] for r in G.nearest_first(graph, "mere").collect()] == []


def test_size_cap():
    out = T.paged([f"name {k}" for k in range(500)], 900, 0, "names", cap=1000)
    assert out["truncated"] and out["next_offset"] == out["count"] == len(out["names"]) < 100


def test_size_cap_at_any_depth():
    out = T.capped({"name": "x", "facts": {"a": [f"value {k}" for k in range(400)], "b": ["one"]}}, cap=1000)
    assert out["truncated"] and out["note"] and 1 <= len(out["facts"]["a"]) < 200 and out["facts"]["b"] == ["one"]
    out = T.capped({"deep": [{"text": "y" * 3000}]}, cap=1000)
    assert out["truncated"] and out["deep"][0]["text"] == "y" * 400 + "…"
    small = {"a": [1, 2]}
    assert T.capped(small) is small and small == {"a": [1, 2]}


def test_modes(tools):
    assert tools.call("list_names", kind="City", limit=1)["names"] == ["Afar"]
    assert T.Tools(tools.graph, ONTO, mode="ingest").call("list_names", kind="City")["status"] == 503


def test_closure_of_a_long_chain(spark):
    n = 150
    pairs = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(n)] + [("000", "100"), (None, "x"), ("x", None)], "s string, o string")
    got = {(r["ancestor"], r["descendant"]): r["depth"] for r in G.transitive_closure(pairs).collect()}
    want = {(f"{a:03}", f"{b:03}"): min(b - a, 1 + b - 100) if a == 0 and b >= 100 else b - a for a in range(n) for b in range(a + 1, n + 1)}
    assert got == want and G.transitive_closure(pairs.limit(0)).collect() == []


def test_versions():
    assert at_least("0.2.0", "0.1.9") and at_least("1.0.0", "1.0.0") and not at_least("0.2.0", "0.10.0")


def test_set_semantics_across_documents(spark):
    q = [(d, "x", "label", "X", "lit", "string") for d in ("d1", "d2")] + [("d1", "x", "type", "Place", "iri", None)]
    g = G.from_quads(spark, spark.createDataFrame(q, "doc_id string, s string, p string, o string, o_kind string, datatype string"), ONTO.type_dim(spark), ONTO.rel_dim(spark))
    assert g.labels.count() == 1 and g.entity_types.where(F.col("type") == "Place").count() == 1
