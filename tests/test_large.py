"""What large inputs need: no pairs of whole groups, and no disk for what is not read any more."""

import os
import time

import pytest

from attestry.operators import resolve as R
from attestry.plans import graph as G
from attestry.queries import QUERIES
from attestry.sources import staging as T


def joined(plan) -> int:
    """Rows that the joins of an executed plan gave."""
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
    below = plan.children()
    return own + sum(joined(below.apply(k)) for k in range(below.size()))


def test_people_and_mentions_are_not_paired(spark):
    people = spark.range(400).selectExpr("'p' || id as id", "'PERSON' as entity_type", "if(id < 399, 'Ann Lee', 'Bo Ray') as canonical_name")
    edges = people.selectExpr("id as subject_entity_id", "'X' as object_entity_id", "'OFFICER_OF' as predicate")
    mentions = spark.range(400).selectExpr("id as mention_id", "if(id < 390, 'A. Lee', 'b. ray') as name", "'X' as issuer_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = R.resolve_person_for_issuer(mentions, people, edges, ("OFFICER_OF",))
        assert {(r.mention_id, r.person_id) for r in found.collect()} == {(k, "p399") for k in range(390, 400)}
        assert joined(found._jdf.queryExecution().executedPlan()) < 5000  # 156,000 as pairs
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def on_disk(spark) -> int:
    """Bytes of shuffles."""
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle"))


def staged(spark) -> list[str]:
    folder = spark.conf.get("spark.checkpoint.dir") + "/attestry"
    return [d for d in os.listdir(folder) if os.listdir(f"{folder}/{d}")] if os.path.isdir(folder) else []


def test_disk_is_free_when_nothing_reads_it(spark):
    T.release(spark)
    before, there = on_disk(spark), set(staged(spark))
    T.stage(spark.range(10), "gone")
    kept = T.stage(spark.range(300_000).repartition(7), "kept").filter("id < 3")
    assert len(set(staged(spark)) - there) == 2
    T.release(spark)
    assert [d[:4] for d in set(staged(spark)) - there] == ["kept"] and kept.count() == 3
    for _ in range(50):  # it takes a moment
        if on_disk(spark) <= before + 100_000:
            break
        time.sleep(0.1)
    assert on_disk(spark) <= before + 100_000  # 300,000 longs were shuffled


@pytest.mark.parametrize("name", ["traverse", "find_path", "ranked_timeline", "backfill_evidence", "ingest_relationships"])
def test_large_work_in_parts(spark, name, monkeypatch):
    """Several parts give the same rows as one."""
    rows = lambda: sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    one = rows()
    monkeypatch.setattr(T, "PART_BYTES", 60_000)
    monkeypatch.setattr(T, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(G, "BROADCAST_ROWS", 20)
    assert rows() == one
