"""A whole batch with every kind of failure, replays, and values that once broke a rule."""

import pytest
from pyspark.sql import functions as F

from attestry.operators import ingest as I
from attestry.operators.batch import ingest_batch
from attestry.plans import graph as G
from attestry.schemas import schema

AS_OF = "2024-01-01T00:00:00Z"


def table(spark, kind, rows):
    names = schema(kind).fieldNames()
    filled = [{"run_id": "run", "source_agent": "agent", "seq": k, **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], schema(kind))


def ids(*pairs):
    return [(s, v, None, None, None, None, None) for s, v in pairs]


def key(name):
    return (None, name, None, None, None)


def named(kind, name, *pairs):
    return (None, None, ids(*pairs), name, kind)


PROOF = {"source_document": (None, "REGISTER", "page-1", None), "evidence": ("line", "OFFICIAL_RECORD", {"row": "4"}), "extraction_method": "TABLE", "assertion_type": "REPORTED", "confidence": 1.0}
NOWHERE = {"source_document": (None, "REGISTER", "page-9", None)}
SOURCE = {"provider": "REGISTER", "document_type": "t", "external_id": "page-1", "source_url": "u", "sha256": "a" * 64, "evidence_class": "OFFICIAL_RECORD", "published_at": "2020-01-01"}


@pytest.fixture(scope="module")
def batch(spark):
    people = [("harbour", "COMPANY"), ("mill", "FUND"), ("oduya", "PERSON"), ("guild", "ORGANIZATION")]
    edges = [("oduya", "CEO_OF", "harbour"), ("mill", "INVESTED_IN", "harbour"), ("oduya", "PARTNER_AT", "mill")]
    good = [{"subject": key(a), "predicate": p, "object": key(b), "source_record_id": f"{a}-{p}", **PROOF} for a, p, b in edges]
    bad = [
        good[0] | {"evidence": (" ", "OFFICIAL_RECORD", None)}, good[1] | {"object": key("nobody"), "source_record_id": "lost"}, good[1] | NOWHERE | {"subject": key("nobody"), "source_record_id": "both"},
        good[2] | {"object": named("NONPROFIT", "New Body"), "source_record_id": "stub"}, good[2] | {"object": named("BODY", "No Such Type"), "source_record_id": "odd"},
        good[1] | {"subject": key("mill"), "predicate": "HOLDS_SECURITY", "evidence": ("was paid", "OFFICIAL_RECORD", None), "source_record_id": "refused"}]
    given = {"attributes": {"sourceAgent": "liar", "evidenceFields": "old", "kept": "1"}}
    return {
        "sources": table(spark, "sources", [SOURCE, {"provider": ""}]),
        "entities": table(spark, "entities", [
            {"candidate_key": k, "entity_type": t, "canonical_name": k.title(), "identifiers": ids(("INTERNAL", k)), "aliases": [k], "source_document": PROOF["source_document"], "evidence": PROOF["evidence"], "extraction_method": "TABLE"}
            for k, t in people] + [{"candidate_key": "nameless", "entity_type": "FUND", "identifiers": ids(("LEI", "none"))}]),
        "identifiers": table(spark, "identifiers", [
            {"entity": (None, None, ids(("INTERNAL", "mill")), None, None), "identifier": ids(("LEI", "L1"))[0], **PROOF}, {"entity": (None, None, ids(("INTERNAL", "harbour")), None, None), "identifier": ids(("LEI", "L1"))[0], **PROOF},
            {"entity": (None, None, ids(("INTERNAL", "nobody")), None, None), "identifier": ids(("LEI", "L2"))[0], **PROOF}]),
        "relationships": table(spark, "relationships", [good[0] | given, *good[1:], *bad]),
        "events": table(spark, "events", [
            {"event_type": "INVESTMENT", "participants": [(key("mill"), "INVESTOR"), (key("harbour"), "RECIPIENT")], "description": "d", "source_record_id": "v1", **PROOF},
            {"event_type": "INVESTMENT", "participants": [(key("nobody"), "INVESTOR")], "description": "d", "source_record_id": "v2", **PROOF},
            {"event_type": "INVESTMENT", "participants": [(key("mill"), "INVESTOR")], "event_date": "soon", "description": "d", "source_record_id": "v3", **PROOF}]),
        "claims": table(spark, "claims", [
            {"subject": key("harbour"), "claim_type": "FINANCIAL_FACT", "statement": "s", "attributes": {"fact": '{"concept":"Cash","unit":"USD","value":5}'}, "source_record_id": "c1", **PROOF},
            {"claim_type": "x", "statement": " ", "source_record_id": "c2", **PROOF}, {"subject": key("nobody"), "claim_type": "x", "statement": "s", "source_record_id": "c3", **PROOF},
            {"subject": key("nobody"), "claim_type": "x", "statement": "s", "source_record_id": "c4", **PROOF, **NOWHERE}]),
    }


@pytest.fixture(scope="module")
def tables(batch):
    return ingest_batch(batch, AS_OF)


def test_counts(tables):
    count = {k: df.count() for k, df in tables.items()}
    want = {"sources": 1, "entities": 5, "relationships": 4, "events": 1, "participants": 2, "claims": 1, "facts": 1, "identifiers": 5, "aliases": 4, "cases": 1}
    assert count == count | want | {"run_sources": 1, "run_relationships": 4, "run_events": 1, "run_claims": 1}
    assert tables["events"].first().event_date == "2020-01-01"


def test_nothing_is_lost_without_a_reason(tables):
    reasons = sorted((r.candidate_type, tuple(r.reasons)) for r in tables["rejections"].collect())
    assert [x for x in reasons if x[0] != "SOURCE"] == sorted([
        ("CLAIM", ("claim subject could not be resolved",)), ("CLAIM", ("source document could not be resolved",)), ("CLAIM", ("statement is required",)),
        ("ENTITY", ("canonical name is required when no authoritative identifier resolves",)), ("ENTITY", ("recognized entity type is required",)),
        ("EVENT", ("invalid event date",)), ("EVENT", ("one or more participants could not be resolved",)), ("IDENTIFIER", ("entity could not be resolved",)),
        ("RELATIONSHIP", ("evidence excerpt is required",)), ("RELATIONSHIP", ("holding is incorrectly described as a payment",)), ("RELATIONSHIP", ("object could not be resolved",)),
        ("RELATIONSHIP", ("object could not be resolved",)), ("RELATIONSHIP", ("subject could not be resolved", "source document could not be resolved"))])
    valid = {(r.candidate_type, r.candidate_key): r.is_valid for r in tables["validations"].collect()}
    assert not valid["RELATIONSHIP", "lost"] and not valid["EVENT", "v2"] and valid["EVENT", "v3"] and valid["CLAIM", "c3"] and not valid["IDENTIFIER", "agent:LEI:L2"]
    assert valid["ENTITY", "agent:NONPROFIT:New Body"] and not valid["ENTITY", "agent:BODY:No Such Type"]
    assert sorted(r.status for r in tables["attachments"].collect()) == ["ATTACHED", "REJECTED", "REVIEW_REQUIRED"]
    case = tables["cases"].first()
    assert case.status == "REVIEW_REQUIRED" and case.source_identifier == "LEI:L1" and case.conflicting_evidence[0]["kind"] == "ENTITY_OWNERSHIP_CONFLICT"
    log = {(r.candidate_type, r.status) for r in tables["resolutions"].collect()}
    assert log == {("ENTITY", "CREATED"), ("ENTITY", "REJECTED"), ("IDENTIFIER", "CREATED"), ("IDENTIFIER", "REVIEW_REQUIRED")}


def test_attributes_and_evidence(tables):
    edge = tables["relationships"].filter("source_record_id = 'oduya-CEO_OF'").first()
    assert edge.attributes == {"kept": "1", "sourceAgent": "agent", "evidenceFields": '{"row":"4"}'}
    kinds = {r.subject_type: r["count"] for r in tables["evidence"].groupBy("subject_type").count().collect()}
    assert kinds == {"ENTITY": 4, "IDENTIFIER": 1, "RELATIONSHIP": 4, "EVENT": 1, "CLAIM": 1}
    assert tables["evidence"].filter("subject_type = 'ENTITY'").first().attributes == {"row": "4", "sourceAgent": "agent"}
    assert tables["claims"].first().attributes["sourceAgent"] == "agent"
    claim = tables["evidence"].filter("subject_type = 'CLAIM'").first()
    assert tables["claims"].first().evidence_assertion_id == claim.id


def test_a_graph_comes_out(spark, tables):
    nodes = tables["entities"].withColumnRenamed("entity_id", "id")
    start = nodes.filter("canonical_name = 'Oduya'").selectExpr("id as root")
    assert {r.distance: r["count"] for r in G.traverse(nodes, tables["relationships"], start, 4)[0].groupBy("distance").count().collect()} == {0: 1, 1: 3}


def test_replay_adds_nothing(batch, tables):
    again = ingest_batch(batch, "2025-01-01T00:00:00Z")
    for name in ("sources", "relationships", "events", "claims", "facts", "evidence", "identifiers", "aliases", "rejections"):
        assert I.new_records(tables[name], again[name]).count() == 0, name
    assert I.new_records(tables["entities"], again["entities"], "entity_id").count() == 0


def test_empty_batch(spark):
    got = ingest_batch({k: table(spark, k, []) for k in ("sources", "entities", "identifiers", "relationships", "events", "claims")}, AS_OF)
    assert all(df.count() == 0 for df in got.values())
    assert "events" not in ingest_batch({"sources": table(spark, "sources", [])}, AS_OF)


def test_many_participants_and_large_numbers(spark):
    far = 2**62
    people = [(named("COMPANY", f"Firm {k}"), "MEMBER") for k in range(5000)]
    batch = {
        "sources": table(spark, "sources", [SOURCE]),
        "events": table(spark, "events", [{"seq": far, "event_type": "MEETING", "participants": people, "description": "d", "source_record_id": "m", **PROOF}]),
        "relationships": table(spark, "relationships", [
            {"seq": far + k, "subject": named("COMPANY", f"Left {k}"), "predicate": "PARENT_OF", "object": named("COMPANY", f"Right {k}"), "source_record_id": str(k), **PROOF} for k in range(300)])}
    got = ingest_batch(batch, AS_OF)
    assert got["participants"].select("entity_id").distinct().count() == 5000
    assert got["relationships"].count() == 300 and got["entities"].count() == 5600


def test_runs(spark):
    runs = I.start_runs(spark.createDataFrame([("a", "filings", None), ("b", "filings", {"k": "v"})], "run_id string, agent_type string, metadata map<string,string>"), AS_OF)
    ends = spark.createDataFrame([("a", "FAILED", ["boom"], "e1")], "run_id string, status string, errors array<string>, target_entity_id string")
    links = {k: spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2")], "run_id string, id string") for k in ("sources", "relationships", "events")}
    got = {r.run_id: r for r in I.finish_runs(runs, ends, links, "2024-02-01").collect()}
    assert (got["a"].status, got["a"].errors, got["a"].completed_at, got["a"].target_entity_id, got["a"].documents_processed) == ("FAILED", ["boom"], "2024-02-01", "e1", 2)
    assert (got["b"].status, got["b"].completed_at, got["b"].relationships_created) == ("RUNNING", None, 0)


def test_upserts_keep_one_row_per_key(spark):
    old = spark.createDataFrame([(1, 0)], "id int, seq int")
    new = spark.createDataFrame([(1, 5), (2, 7), (2, 6), (2, 6), (None, 1), (None, 2)], "id int, seq int")
    assert sorted(map(tuple, I.upsert_first(old, new.filter("id is not null"), order="seq").collect())) == [(1, 0), (2, 6)]
    assert sorted(map(tuple, I.upsert_last(old, new.filter("id is not null"), order="seq").collect())) == [(1, 5), (2, 7)]
    assert I.upsert_first(old, new).groupBy("id").count().filter("count > 1").count() == 0
    from attestry.operators.survivorship import first_wins

    assert sorted((r.id or 0, r.seq) for r in first_wins(new, "id").collect()) == [(0, 1), (1, 5), (2, 6)]


def test_stream_of_batches(spark, tmp_path):
    from attestry.sources.store import Store
    from attestry.streaming import streams

    one = F.array(F.struct(*[F.lit(v).alias(k) for k, v in SOURCE.items()], F.lit("agent").alias("source_agent")))
    ent = F.array(F.struct(F.lit("COMPANY").alias("entity_type"), F.col("name").alias("canonical_name"), F.lit("agent").alias("source_agent"), F.col("ids").alias("identifiers")))
    rows = spark.createDataFrame([(k, f"Firm {k}", ids(("LEI", "same"))) for k in range(2)], "batch_seq long, name string, ids " + schema("entities")["identifiers"].dataType.simpleString())
    for k in range(2):
        rows.filter(F.col("batch_seq") == k).select(F.lit("run").alias("run_id"), "batch_seq", one.alias("sources"), ent.alias("entities")).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in" / "part=0")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    store = Store(spark, str(tmp_path / "out"), 4)
    streams.stream_batches(stream, store, str(tmp_path / "check"), AS_OF).awaitTermination()
    assert store.committed() == 1 and store.read("sources").count() == 1
    assert store.read("identifiers").select("entity_id").distinct().count() == 1
