"""References of records to entities and sources.

Most records name the same few entities, so references are resolved once per content: a digest of what a reference
says stands for it, the distinct ones are resolved in a narrow table, and records find the answer by the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import candidate_key, stable_id
from ..sources.staging import in_order, same_rows, small, stage
from .survivorship import first_authoritative
from .validate import validate_entities


def digest(*said: Column) -> Column:
    """128 bits of some columns, cheap to take and to send. Nulls count: a hash alone would pass them over."""
    each = [x for c in said for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(1), *each).alias("a"), F.xxhash64(F.lit(2), *each).alias("b"))


def ref_key(run_id: Column, ref: Column) -> Column:
    """A digest of the run and what a reference can be resolved by; null for no reference."""
    ids = F.transform(ref["identifiers"], lambda i: F.struct(i["scheme"].isNull(), i["scheme"], i["value"].isNull(), i["value"]))
    return F.when(ref.isNotNull(), digest(run_id, ref["entity_id"], ref["candidate_key"], F.size(ref["identifiers"]), ids))


def stubable(ref: Column) -> Column:
    """Whether a reference that nothing answers to can make an entity."""
    return (F.coalesce(ref["entity_type"], F.lit("")) != "") & (F.coalesce(ref["canonical_name"], F.lit("")) != "")


def known_refs(refs: DataFrame, entities: DataFrame, run_keys: DataFrame, owners: DataFrame) -> tuple[DataFrame, bool]:
    """(key, entity_id) of the distinct references (key, run_id, ref) that something known answers to, and whether any other could make an entity.

    In turn: an entity id that exists, a key of this run, any identifier in array order. What was known before a kind is
    taken counts before what references of that kind bring in.
    """
    ids = F.transform("ref.identifiers", lambda i: F.struct(i["scheme"].alias("scheme"), i["value"].alias("value")))
    said = F.struct("run_id", F.col("ref.entity_id").alias("given"), F.col("ref.candidate_key").alias("candidate_key"), ids.alias("ids"))
    asked = stage(refs.filter("key is not null").groupBy("key").agg(F.first(said).alias("r"), F.bool_or(stubable(F.col("ref"))).alias("able")).select("key", "able", "r.*"), "asked")
    by_id = entities.select(F.col("entity_id").alias("given")).distinct().withColumn("_by_id", F.col("given"))
    keys = run_keys.filter("entity_id is not null and candidate_key is not null")
    by_key = keys.groupBy("run_id", "candidate_key").agg(F.min("entity_id").alias("_by_key"))
    owned = owners.groupBy("scheme", "value").agg(F.min("entity_id").alias("entity_id"))
    each = asked.select("key", F.posexplode("ids").alias("pos", "i")).select("key", "pos", "i.scheme", "i.value")
    by_ids = each.join(owned, ["scheme", "value"]).groupBy("key").agg(F.min(F.struct("pos", "entity_id")).alias("_m"))
    found = asked.join(by_id, "given", "left").join(by_key, ["run_id", "candidate_key"], "left").join(by_ids, "key", "left")
    found = stage(found.select("key", "able", F.coalesce("_by_id", "_by_key", "_m.entity_id").alias("entity_id")), "answered")
    return small(found.filter("entity_id is not null").select("key", "entity_id"), "known"), not found.filter("able and entity_id is null").isEmpty()


def make_stubs(left: DataFrame, run_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, stubs) for references that nothing known answers to: (seq, pos, run_id, source_agent, ref).

    A reference with a type and a name makes an entity. References are taken in the order of seq and pos: a key of the
    run, or any identifier, that an earlier one brought in answers a later one. Who makes an entity depends on who made
    one before, so the makers are sought until they stay the same.

    answers: seq, pos, entity_id. stubs: entity candidates, valid or not, of those that made one or tried to, with
    their entity_id, key and order.
    """
    ref = F.col("ref")
    no_ids = F.array().cast(left.schema["ref"].dataType["identifiers"].dataType)
    flat = left.select(
        "seq", "pos", "run_id", "source_agent", stubable(ref).alias("able"), ref["candidate_key"].alias("given_key"), ref["entity_type"].alias("entity_type"),
        ref["canonical_name"].alias("canonical_name"), F.coalesce(ref["identifiers"], no_ids).alias("identifiers"))
    rows = in_order(flat, ["seq", "pos"], "stub-order", "n")
    own_key = candidate_key(F.col("run_id"), F.concat_ws("/", "seq", "pos"), F.col("given_key"), *[F.col(c) for c in ("source_agent", "entity_type", "canonical_name", "identifiers")])
    rows = rows.withColumn("candidate_key", F.when(F.col("able"), own_key))
    none = {c: F.lit(None).cast(t) for c, t in (
        ("confidence", "double"), ("evidence", "struct<excerpt:string,evidence_class:string>"), ("extraction_method", "string"), ("assertion_type", "string"),
        ("source_document", "struct<source_document_id:string,provider:string,external_id:string>"))}
    checked = validate_entities(rows.withColumns(none)).drop(*none)
    before = run_keys.filter("entity_id is not null").groupBy("run_id", "candidate_key").agg(F.min("entity_id").alias("remembered"))
    rows = stage(checked.join(before, ["run_id", "candidate_key"], "left"), "stub-refs")
    each = stage(rows.select("n", F.posexplode("identifiers").alias("at", "i")).select("n", "at", "i.scheme", "i.value"), "stub-ids")
    usual = F.col("able") & F.col("valid") & F.col("remembered").isNull()
    makers, last = stage(rows.filter(usual).select("n", "run_id", "candidate_key"), "makers"), None
    while True:
        by_key = makers.groupBy("run_id", "candidate_key").agg(F.min("n").alias("by_key"))
        by_id = each.join(makers.select("n"), "n").groupBy("scheme", "value").agg(F.min("n").alias("by_id"))
        met = each.join(by_id, ["scheme", "value"]).filter(F.col("by_id") < F.col("n")).groupBy("n").agg(F.min(F.struct("at", "by_id")).alias("_m"))
        given = rows.filter("given_key is not null").join(by_key, (rows["run_id"] == by_key["run_id"]) & (rows["given_key"] == by_key["candidate_key"])).filter(F.col("by_key") < F.col("n")).select("n", "by_key")
        computed = rows.filter("able and given_key is null").join(by_key, ["run_id", "candidate_key"]).filter(F.col("by_key") < F.col("n")).select("n", F.col("by_key").alias("by_own"))
        of = F.coalesce("by_key", F.col("_m.by_id"), "by_own")
        pointed = rows.select("n").join(given, "n", "left").join(met, "n", "left").join(computed, "n", "left").select("n", of.alias("maker"))
        pointed = stage(pointed.filter("maker is not null"), "pointed")
        makers = stage(rows.filter(usual).select("n", "run_id", "candidate_key").join(pointed.select("n"), "n", "left_anti"), "makers")
        if last is not None and same_rows(makers, last, "n"):
            break
        last = makers
    auth = first_authoritative(F.col("identifiers"))
    entity = F.when(auth.isNotNull(), stable_id("entity", F.concat_ws(":", auth["scheme"], auth["value"]))).otherwise(stable_id("entity-unresolved", F.col("run_id"), F.col("candidate_key")))
    made = rows.join(makers.select("n"), "n").withColumn("entity_id", entity)
    ids = small(made.select(F.col("n").alias("maker"), "entity_id"), "made")
    through = pointed.join(ids, "maker").select("n", "entity_id")
    kept = rows.filter("remembered is not null").join(pointed.select("n"), "n", "left_anti").select("n", F.col("remembered").alias("entity_id"))
    answers = rows.select("n", "seq", "pos").join(through.unionByName(kept).unionByName(ids.withColumnRenamed("maker", "n")), "n").select("seq", "pos", "entity_id")
    refused = rows.filter("able and not valid").join(pointed.select("n"), "n", "left_anti").withColumn("entity_id", F.lit(None).cast("string"))
    return stage(answers, "answers"), stage(made.unionByName(refused).drop("able", "given_key", "remembered"), "stubs")


def resolve_refs(rows: DataFrame, ends: dict[str, str], entities: DataFrame, run_keys: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows (run_id, seq, source_agent, reference columns) with an entity per end, and the stubs that were made, if any.

    ends: name of the answer's column -> name of the reference column. rows should be staged.
    """
    keyed = rows.withColumns({f"_k_{name}": ref_key(F.col("run_id"), F.col(c)) for name, c in ends.items()})
    asked = None
    for name, c in ends.items():
        one = keyed.select(F.col(f"_k_{name}").alias("key"), "run_id", F.col(c).alias("ref"))
        asked = one if asked is None else asked.unionByName(one)
    found, more = known_refs(asked, entities, run_keys, owners)
    for name in ends:
        keyed = keyed.join(found.select(F.col("key").alias(f"_k_{name}"), F.col("entity_id").alias(name)), f"_k_{name}", "left")
    keyed = keyed.drop(*[f"_k_{name}" for name in ends])
    if not more:
        return keyed, None
    keyed = stage(keyed, "keyed")
    parts = [keyed.filter(F.col(name).isNull() & F.col(c).isNotNull()).select("seq", F.lit(k).alias("pos"), "run_id", "source_agent", F.col(c).alias("ref")) for k, (name, c) in enumerate(ends.items())]
    left = parts[0]
    for p in parts[1:]:
        left = left.unionByName(p)
    left = stage(left, "left")
    answers, stubs = make_stubs(left, run_keys)
    answers = small(answers, "stub-answers")
    for k, name in enumerate(ends):
        mine = answers.filter(F.col("pos") == k).select("seq", F.col("entity_id").alias("_stub"))
        keyed = keyed.join(mine, "seq", "left").withColumn(name, F.coalesce(name, "_stub")).drop("_stub")
    return keyed, stubs


def source_key(ref: Column) -> Column:
    return digest(*[ref[c] for c in ("source_document_id", "provider", "external_id", "sha256")])


def known_sources(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """refs (source_document ...) with source_id: by id if given, else the newest version of provider and external id."""
    r = F.col("source_document")
    given = F.coalesce(r["source_document_id"], F.lit("")) != ""
    keyed = refs.withColumns({
        "_id": F.when(given, r["source_document_id"]), "_provider": F.when(~given, r["provider"]), "_external": F.when(~given, r["external_id"]), "_sha": r["sha256"]})
    by_id = sources.select(F.col("id").alias("_id"), F.col("id").alias("_s1")).distinct()
    key = (F.col("provider").alias("_provider"), F.col("external_id").alias("_external"))
    newest = F.max(F.struct("retrieved_at", "id"))["id"]
    exact = sources.groupBy(*key, F.col("sha256").alias("_sha")).agg(newest.alias("_s2"))
    latest = sources.groupBy(*key).agg(newest.alias("_s3"))
    out = keyed.join(by_id, "_id", "left").join(exact, ["_provider", "_external", "_sha"], "left").join(latest, ["_provider", "_external"], "left")
    picked = F.coalesce("_s1", F.when(F.coalesce(F.col("_sha"), F.lit("")) != "", F.col("_s2")).otherwise(F.col("_s3")))
    return out.select(*refs.columns, picked.alias("source_id"))


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with source_id and what records inherit of their source; each distinct reference is resolved once."""
    return laid_over(rows, sources_of(rows, sources))


def sources_of(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """What is known of the distinct sources that rows refer to."""
    asked = rows.withColumn("_source", source_key(F.col("source_document"))).groupBy("_source").agg(F.first("source_document").alias("source_document"))
    about = sources.select(F.col("id").alias("source_id"), "source_url", F.col("provider").alias("source_provider"), "published_at", "filed_at")
    return small(known_sources(asked, sources).join(about, "source_id").select("_source", *about.columns), "sources-found")


def laid_over(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with what sources_of found."""
    return rows.withColumn("_source", source_key(F.col("source_document"))).join(found, "_source", "left").drop("_source")


def resolve_entity_refs(refs: DataFrame, entities: DataFrame, run_keys: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """refs (ref_id, run_id, seq, source_agent, ref) with entity_id, and the stubs that were made, if any; ref_id orders refs of one seq."""
    keyed = refs.withColumn("_k", ref_key(F.col("run_id"), F.col("ref")))
    found, more = known_refs(keyed.select(F.col("_k").alias("key"), "run_id", "ref"), entities, run_keys, owners)
    out = keyed.join(found.withColumnRenamed("key", "_k"), "_k", "left").drop("_k")
    if not more:
        return out, None
    out = stage(out, "refs")
    left = stage(out.filter("entity_id is null and ref is not null").select("seq", F.col("ref_id").alias("pos"), "run_id", "source_agent", "ref"), "left")
    answers, stubs = make_stubs(left, run_keys)
    mine = small(answers, "stub-answers").select("seq", F.col("pos").alias("ref_id"), F.col("entity_id").alias("_stub"))
    return out.join(mine, ["seq", "ref_id"], "left").withColumn("entity_id", F.coalesce("entity_id", "_stub")).drop("_stub"), stubs
