"""Set-based resolution against the sequential rules, on random candidates."""

import random

from attestry.functions.vocabulary import AUTHORITATIVE_SCHEMES
from attestry.operators import resolve as R
from attestry.operators import survivorship as S

SCHEMA = "seq long, run_id string, candidate_key string, source_agent string, entity_type string, canonical_name string, identifiers array<struct<scheme:string,value:string,jurisdiction:string>>"


def sequential(rows):
    """One candidate after another: the entity of each as the seq of the candidate that made it."""
    owner, memory, out = {}, {}, {}
    for seq, run, key, agent, kind, name, ids in rows:
        if key is None:
            key = f"{agent}:{kind}:lonely{seq}" if kind == "PERSON" and not ids else f"{agent}:{kind}:" + (name if name is not None else "|".join(f"{s}:{v}" for s, v, _ in ids))
        if (run, key) in memory:
            out[seq] = memory[run, key]
            continue
        first = next(((s, v) for s, v, _ in ids if s in AUTHORITATIVE_SCHEMES), None)
        found = owner.get(first)
        if name == "" or (name is None and found is None):
            out[seq] = None
            continue
        entity = found if found is not None else seq
        for s, v, _ in ids:
            owner.setdefault((s, v), entity)
        memory[run, key] = out[seq] = entity
    return out


def test_same_as_one_by_one(spark):
    rnd = random.Random(5)
    for trial in range(4):
        rows = []
        for seq in range(120):
            ids = [(rnd.choice(["LEI", "EIN", "TICKER"]), f"v{rnd.randint(0, 14)}", None) for _ in range(rnd.randint(0, 3))]
            rows.append((seq, f"r{rnd.randint(0, 1)}", rnd.choice([None, None, f"k{rnd.randint(0, 30)}"]), "a", rnd.choice(["PERSON", "COMPANY"]), rnd.choice([None, "", "x", "y", "z", "w"]), ids))
        want = sequential(rows)
        got = R.resolve_entities(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        entity = {r.seq: r.entity_id for r in got}
        made = {}
        for seq, root in want.items():
            if root is None:
                assert entity[seq] is None, (trial, seq)
            else:
                assert entity[seq] is not None and made.setdefault(root, entity[seq]) == entity[seq], (trial, seq)
        assert len(set(made.values())) == len(made)


def test_names_never_merge(spark):
    lei = [("LEI", "LEI-EXAMPLE-1", None)]
    rows = [(1, "r", None, "a", "COMPANY", "Example Holdings Ltd", lei), (2, "r", None, "b", "COMPANY", "Example Holdings Limited", lei), (3, "r", None, "a", "PERSON", "Alex Smith", []), (4, "r", None, "a", "PERSON", "Alex Smith", []), (5, "r", None, "a", "ORGANIZATION", "Shared Name LLC", []), (6, "r", None, "b", "ORGANIZATION", "Shared Name LLC", [])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.seq: r.entity_id for r in R.resolve_entities(df).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 5


def test_unknown_people(spark):
    people = spark.createDataFrame([("p1", "PERSON", "Ann Lee"), ("p2", "PERSON", "李"), ("p3", "PERSON", "Bob Lee")], "id string, entity_type string, canonical_name string")
    edges = spark.createDataFrame([(p, "org", "OFFICER_OF") for p in ("p1", "p2", "p3")], "subject_entity_id string, object_entity_id string, predicate string")
    asked = spark.createDataFrame([(1, "A. Lee", "org"), (2, "王", "org"), (3, "lee", "org"), (4, "bob LEE", "org")], "mention_id int, name string, issuer_id string")
    assert {r.mention_id: r.person_id for r in R.resolve_person_for_issuer(asked, people, edges, ("OFFICER_OF",)).collect()} == {1: "p1", 4: "p3"}


def test_attributes_merge_by_key(spark):
    rows = [("e", 1, {"a": "1", "b": "2"}), ("e", 2, {"b": None, "c": "3"})]
    df = spark.createDataFrame(rows, "entity_id string, seq long, attributes map<string,string>")
    assert S.merge_attributes(df, "entity_id").first().attributes == {"a": "1", "b": None, "c": "3"}
