"""References resolved together against the same taken one by one."""

import random

from attestry.operators import references as L

IDS = "array<struct<scheme:string,value:string,jurisdiction:string>>"
SCHEMA = f"ref_id long, run_id string, seq long, source_agent string, ref struct<entity_id:string,candidate_key:string,identifiers:{IDS},canonical_name:string,entity_type:string>"


def one_by_one(refs, entities, keys, owners):
    """What was known before counts first; then what earlier references brought in."""
    memory, own, out = {}, {}, {}
    for ref_id, run, seq, agent, (given, key, ids, name, kind) in sorted(refs, key=lambda r: (r[2], r[0])):
        found = given if given in entities else keys.get((run, key)) or next((owners[s, v] for s, v, _ in ids if (s, v) in owners), None)
        found = found or memory.get((run, key)) or next((own[s, v] for s, v, _ in ids if (s, v) in own), None)
        if found is None and kind and name:
            full = key or (f"lonely-{seq}-{ref_id}" if kind == "PERSON" and not ids else f"{agent}:{kind}:{name}")
            found = keys.get((run, full)) or memory.get((run, full))
            if found is None and kind != "THING" and len(set(ids)) == len(ids):
                found = memory[run, full] = ("made", seq, ref_id)
                for s, v, _ in ids:
                    own.setdefault((s, v), found)
        out[seq, ref_id] = found
    return out


def test_same_as_one_by_one(spark):
    rnd = random.Random(11)
    entities, keys, owners = {"e1"}, {("r0", "k0"): "e2"}, {("LEI", "v0"): "e3", ("TICKER", "v1"): "e4"}
    for trial in range(3):
        refs = []
        for n in range(150):
            ids = [(rnd.choice(["LEI", "TICKER"]), f"v{rnd.randint(0, 25)}", None) for _ in range(rnd.choice([0, 0, 1, 2]))]
            ref = (rnd.choice([None, None, None, "e1", "gone"]), rnd.choice([None, None, f"k{rnd.randint(0, 20)}"]), ids, rnd.choice([None, "", "x", "y", "z"]), rnd.choice([None, "COMPANY", "COMPANY", "PERSON", "THING"]))
            refs.append((n % 4, f"r{rnd.randint(0, 1)}", n // 4, "a", ref))
        want = one_by_one(refs, entities, keys, owners)
        got, stubs = L.resolve_entity_refs(
            spark.createDataFrame(refs, SCHEMA).repartition(5), spark.createDataFrame([(e,) for e in entities], "entity_id string"),
            spark.createDataFrame([(r, k, e) for (r, k), e in keys.items()], "run_id string, candidate_key string, entity_id string"), spark.createDataFrame([(s, v, e) for (s, v), e in owners.items()], "scheme string, value string, entity_id string"))
        entity, made = {(r.seq, r.ref_id): r.entity_id for r in got.collect()}, {}
        assert len(entity) == len(refs)
        for at, root in want.items():
            if root is None or isinstance(root, str):
                assert entity[at] == root, (trial, at)
            else:
                assert entity[at] is not None and made.setdefault(root, entity[at]) == entity[at], (trial, at)
        assert len(set(made.values())) == len(made) == stubs.filter("entity_id is not null").count()


def test_stubs_of_one_record_are_apart(spark):
    refs = [(pos, "r", 7, "a", (None, None, [], f"Name {seq} {pos}", "COMPANY")) for seq in range(1) for pos in range(6000)]
    none = [spark.createDataFrame([], s) for s in ("entity_id string", "run_id string, candidate_key string, entity_id string", "scheme string, value string, entity_id string")]
    got, _ = L.resolve_entity_refs(spark.createDataFrame(refs, SCHEMA), *none)
    assert got.count() == got.select("entity_id").distinct().count() == 6000
