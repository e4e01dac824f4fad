"""Graph questions on a small harbour: a shipping line, its owner, a bank and a pilots' guild."""

import pytest
from pyspark.sql import functions as F

from attestry.functions import columns as C
from attestry.plans import graph as G
from attestry.sources.extract import parse_subsidiaries, unique_subsidiaries

NODES = [("owner", "PERSON", "Ines Moreau"), ("line", "COMPANY", "Blue Line Shipping"), ("bank", "FUND", "Quay Bank"), ("pilot", "PERSON", "Jon Pilot"), ("guild", "ORGANIZATION", "Pilots Guild"), ("yard", "COMPANY", "Old Yard")]
EDGES = [
    ("e1", "owner", "DIRECTOR_OF", "line", "2001-02-01", "2003-01-31"), ("e2", "bank", "HOLDS_SECURITY", "line", "2002-05-01", None), ("e3", "pilot", "WORKED_AT", "bank", "2004-01-01", None),
    ("e4", "pilot", "PARTNER_AT", "guild", "1999-01-01", "2003-12-31"), ("e5", "line", "ACQUIRED", "yard", "2005-01-01", None), ("e6", "yard", "ISSUED_BY", "bank", "2006-01-01", None),
]
EDGE = "id string, subject_entity_id string, predicate string, object_entity_id string, valid_from string, valid_to string, observed_at string"


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(NODES, "id string, entity_type string, canonical_name string"), spark.createDataFrame([(*e, None) for e in EDGES], EDGE)


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def test_traversal(spark, graph):
    for depth, count in ((1, 2), (2, 4), (3, 5), (4, 6)):
        assert G.traverse(*graph, roots(spark, "owner"), depth)[0].count() == count
    with pytest.raises(ValueError):
        G.traverse(*graph, roots(spark, "owner"), 5)
    assert [r.edge_id for r in G.traverse(*graph, roots(spark, "owner"), 4, predicates=["DIRECTOR_OF"])[1].collect()] == ["e1"]
    assert G.traverse(*graph, roots(spark, "nobody"), 2)[0].count() == 0
    nodes, edges = G.traverse(*graph, roots(spark, "owner"), 2, entity_types=["COMPANY"])
    assert {r.id for r in nodes.collect()} == {"owner", "line", "yard"} and {r.edge_id for r in edges.collect()} == {"e1", "e5"}


@pytest.mark.parametrize("hub", [50_000, 1])
def test_partitions_and_hubs_change_nothing(spark, graph, hub, monkeypatch):
    nodes, edges = graph
    one = G.traverse(nodes, edges.repartition(1), roots(spark, "owner", "pilot"), 3)
    monkeypatch.setattr(G, "HUB", hub)
    many = G.traverse(nodes.repartition(7), edges.repartition(7), roots(spark, "pilot", "owner"), 3)
    for a, b in zip(one, many):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("hub", [50_000, 1])
def test_path(spark, graph, hub, monkeypatch):
    monkeypatch.setattr(G, "HUB", hub)
    pairs = spark.createDataFrame([("owner", "guild"), ("owner", "owner")], "source string, target string")
    hops = G.find_path(*graph, pairs, ranks=G.edge_ranks(graph[1])).orderBy("hop").collect()
    far = [h for h in hops if h.target == "guild"]
    assert [h.depth for h in far] == [4] * 4 and [h.to_id for h in far] == ["line", "bank", "pilot", "guild"] and [h.way for h in far] == ["out", "in", "in", "out"]
    assert [h.depth for h in hops if h.target == "owner"] == [0]
    lost = G.find_path(*graph, pairs, depth=2).filter("target = 'guild'").collect()
    assert [(h.depth, h.edge_id) for h in lost] == [(None, None)]


def test_careers_and_trail(spark, graph):
    got = {(r.person_id, r.organization_id): r for r in G.career_transitions(*graph).collect()}
    assert got["pilot", "bank"].previous_edge_id == "e4" and got["pilot", "guild"].next_edge_id == "e3"
    visits = spark.createDataFrame([(1, k, p) for k, p in enumerate("aaba")], "user_id int, at int, place string")
    assert G.traversal_trail(visits).first().trail == ["a", "b", "a"] and G.traversal_trail(visits, 2).first().trail == ["b", "a"]


def test_timeline_order(spark, graph):
    events = spark.createDataFrame([("v1", "2002-05-01")], "id string, event_date string")
    people = spark.createDataFrame([("v1", "line", "CARRIER")], "event_id string, entity_id string, role string")
    line = G.ranked_timeline(G.timeline(graph[1], events, people)).filter("entity_id = 'line'").orderBy("rank").collect()
    assert [(r.rank, r.record_id) for r in line] == [(1, "e5"), (2, "v1"), (3, "e2"), (4, "e1")]


def test_search_plan_and_result(spark, graph):
    wide = graph[0].withColumns({c: F.lit(None).cast("string") for c in ("aliases", "identifiers", "ticker", "tickers")})
    asked = spark.createDataFrame([("quay bank",), (" ",), ("blue",), ("pilot",)], "query string")
    found = G.search_entities(wide, asked)
    assert {(r.query, r.rank, r.id, r.score) for r in found.collect()} == {("quay bank", 1, "bank", 100), ("blue", 1, "line", 80), ("pilot", 1, "guild", 80), ("pilot", 2, "pilot", 50)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = G.search_entities(wide, asked)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_subsidiaries(spark):
    page = "<table><tr><th>Jurisdiction</th></tr><tr><td>Salt &amp; Rope GmbH</td><td>Bremen</td></tr><tr><td>Tide Works Oy</td><td>Turku</td></tr></table>"
    twice = "<tr><td>Subsidiary</td></tr><tr><td>X Ltd</td></tr><tr><td>x ltd</td></tr><tr><td>7</td></tr>"
    rows = unique_subsidiaries(parse_subsidiaries(spark.createDataFrame([(1, page), (2, twice), (3, ""), (4, None)], "doc_id int, html string"))).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.name, r.jurisdiction, r.evidence) for r in rows] == [(1, "Salt & Rope GmbH", "Bremen", "Salt & Rope GmbH — Bremen"), (1, "Tide Works Oy", "Turku", "Tide Works Oy — Turku"), (2, "X Ltd", None, "X Ltd")]


def test_odd_character_references(spark):
    texts = ["&#xD800; &#55296;", "&#" + "9" * 5000 + ";", "&#x0000000041;&#65;", "&#xZZ; &#; &amp;lt;", "&#x110000;"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "k int, s string").orderBy("k").select(C.decode_html(F.col("s")).alias("t")).collect()]
    assert got == [texts[0], texts[1], "AA", "&#xZZ; &#; &lt;", texts[4]]
