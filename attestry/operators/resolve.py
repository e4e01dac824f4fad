"""Resolution: authoritative identifiers converge, names alone never merge.

The rules depend on order, so all candidates carry `seq`. Whoever first carried an identifier owns it; a candidate
belongs to the owner of its first authoritative identifier. Owners always come earlier, so the pointers form a forest
that pointer jumping flattens in a logarithmic number of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import candidate_key, identifier_list, normalize_name, stable_id
from ..sources.staging import same_rows, stage
from .survivorship import first_authoritative, first_wins, last_wins

#: Identifiers of entities that exist before the run: scheme, value, entity_id.
OWNERS = "scheme string, value string, entity_id string"


def with_keys(candidates: DataFrame) -> DataFrame:
    key = candidate_key(*[F.col(c) for c in ("run_id", "seq", "candidate_key", "source_agent", "entity_type", "canonical_name", "identifiers")])
    return candidates.withColumn("candidate_key", key)


def dedupe_within_run(candidates: DataFrame) -> DataFrame:
    """The first candidate of each run and key; later ones return its entity and nothing of theirs is used."""
    return first_wins(candidates, "run_id", "candidate_key")


def identifier_rows(candidates: DataFrame) -> DataFrame:
    return candidates.select("seq", F.explode("identifiers").alias("i")).select("seq", F.col("i.scheme").alias("scheme"), F.col("i.value").alias("value"))


def _slim(candidates: DataFrame) -> DataFrame:
    auth = first_authoritative(F.col("identifiers"))
    ids = F.transform("identifiers", lambda i: F.struct(i["scheme"].alias("scheme"), i["value"].alias("value")))
    return with_keys(candidates).select("run_id", "seq", "candidate_key", (F.coalesce("canonical_name", F.lit("-")) != "").alias("not_empty"), F.col("canonical_name").isNotNull().alias("named"), ids.alias("identifiers"), auth["scheme"].alias("scheme"), auth["value"].alias("value"))


def _holders(kept: DataFrame, owners: DataFrame | None) -> DataFrame:
    """(scheme, value, holder, known): the earliest candidate with the identifier, -1 and the entity where it existed before."""
    first = identifier_rows(kept).groupBy("scheme", "value").agg(F.min("seq").alias("holder"))
    if owners is None:
        return first.withColumn("known", F.lit(None).cast("string"))
    known = owners.groupBy("scheme", "value").agg(F.min("entity_id").alias("known"))
    both = first.join(known, ["scheme", "value"], "full")
    return both.select("scheme", "value", F.when(F.col("known").isNotNull(), F.lit(-1).cast("long")).otherwise(F.col("holder")).alias("holder"), "known")


def resolve_entities(candidates: DataFrame, owners: DataFrame | None = None, run_keys: DataFrame | None = None) -> DataFrame:
    """One row per valid candidate: run_id, seq, candidate_key, kept, entity_id, status (CREATED, RESOLVED, REMEMBERED, REJECTED), scheme.

    owners: identifiers of earlier batches (scheme, value, entity_id). run_keys: what keys of a run stood for in earlier
    batches (run_id, candidate_key, entity_id); their candidates are remembered.
    """
    rows = stage(_slim(candidates), "candidates")
    if run_keys is not None:
        before = run_keys.filter("entity_id is not null").groupBy("run_id", "candidate_key").agg(F.min("entity_id").alias("entity_id"))
        known = stage(rows.join(before, ["run_id", "candidate_key"]), "remembered")
        rows = stage(rows.join(known.select("seq"), "seq", "left_anti"), "candidates")
        told = known.select("run_id", "seq", "candidate_key", F.lit(False).alias("kept"), "entity_id", F.lit("REMEMBERED").alias("status"), "scheme")
        return _resolved(rows, owners).unionByName(told)
    return _resolved(rows, owners)


def _resolved(rows: DataFrame, owners: DataFrame | None) -> DataFrame:
    named = rows.filter("named and not_empty")
    unnamed = rows.filter("not named")
    accepted = named
    if not unnamed.isEmpty():
        # an unnamed candidate needs an identifier that resolves; who owns it depends on who is accepted
        before = None
        while True:
            holders = _holders(dedupe_within_run(accepted), owners)
            found = unnamed.join(holders, ["scheme", "value"]).filter(F.col("holder") < F.col("seq")).select(*rows.columns)
            found = stage(found, "unnamed")
            accepted = named.unionByName(found)
            if before is not None and same_rows(found, before, "seq"):
                break
            before = found
    kept = stage(dedupe_within_run(accepted), "kept")
    holders = _holders(kept, owners)
    linked = kept.join(holders, ["scheme", "value"], "left")
    earlier = F.col("holder") < F.col("seq")
    own = F.when(F.col("scheme").isNotNull(), stable_id("entity", F.concat_ws(":", "scheme", "value"))).otherwise(stable_id("entity-unresolved", F.col("run_id"), F.col("candidate_key")))
    forest = linked.select("seq", F.when(earlier & (F.col("holder") >= 0), F.col("holder")).otherwise(F.col("seq")).alias("parent"), F.coalesce(F.when(earlier, F.col("known")), own).alias("own_id"), F.coalesce(earlier, F.lit(False)).alias("resolved"))
    forest = stage(forest, "forest")
    while True:
        up = forest.select(F.col("seq").alias("parent"), F.col("parent").alias("top"), F.col("own_id").alias("top_id"))
        step = stage(forest.join(up, "parent").select("seq", F.col("top").alias("parent"), "own_id", "top_id", "resolved", (F.col("top") != F.col("parent")).alias("moved")), "forest")
        forest = step.drop("top_id", "moved")
        if not step.filter("moved").limit(1).count():
            break
    root = step.select("seq", F.col("top_id").alias("entity_id"), "resolved")
    kept_rows = kept.join(root, "seq").select("run_id", "candidate_key", F.col("seq").alias("kept_seq"), "entity_id", "resolved")
    joined = rows.join(kept_rows, ["run_id", "candidate_key"], "left")
    mine = F.col("kept_seq") == F.col("seq")
    has = F.col("kept_seq") <= F.col("seq")
    status = F.when(mine & F.col("resolved"), "RESOLVED").when(mine, "CREATED").when(has, "REMEMBERED").otherwise("REJECTED")
    return joined.select("run_id", "seq", "candidate_key", F.coalesce(mine, F.lit(False)).alias("kept"), F.when(has, F.col("entity_id")).alias("entity_id"), status.alias("status"), "scheme")


def resolution_log(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """The last decision per run, key, entity and status, with confidence and reason."""
    rows = candidates.select("seq", "confidence").join(resolved.filter("status != 'REMEMBERED'"), "seq")
    sure = F.coalesce("confidence", F.when(F.col("scheme").isNotNull(), 1.0).otherwise(0.8))
    reason = (
        F.when(F.col("status") == "REJECTED", "canonical name is required when no authoritative identifier resolves")
        .when(F.col("status") == "RESOLVED", F.concat(F.lit("matched authoritative identifier "), "scheme"))
        .when(F.col("scheme").isNotNull(), F.concat(F.lit("created from authoritative identifier "), "scheme"))
        .otherwise("created as a distinct unresolved identity; name-only merging is disabled")
    )
    out = rows.select(
        "run_id", "seq", "candidate_key", F.lit("ENTITY").alias("candidate_type"), F.col("entity_id").alias("proposed_entity_id"), "status",
        F.when(F.col("status") == "REJECTED", 0.0).otherwise(sure).alias("confidence"), F.array(reason).alias("reasons"))
    return last_wins(with_resolution_id(out), "id")


def with_resolution_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", stable_id("resolution", F.col("run_id"), F.col("candidate_key"), F.col("proposed_entity_id"), F.col("status")))


def stub_log(stubs: DataFrame) -> DataFrame:
    """The resolution log of entities that references made."""
    auth = first_authoritative(F.col("identifiers"))["scheme"]
    reason = F.when(auth.isNotNull(), F.concat(F.lit("created from authoritative identifier "), auth)).otherwise("created as a distinct unresolved identity; name-only merging is disabled")
    rows = stubs.filter("entity_id is not null").select(
        "run_id", "seq", "candidate_key", F.lit("ENTITY").alias("candidate_type"), F.col("entity_id").alias("proposed_entity_id"), F.lit("CREATED").alias("status"),
        F.when(auth.isNotNull(), 1.0).otherwise(0.8).alias("confidence"), F.array(reason).alias("reasons"))
    return with_resolution_id(rows)


def attachment_log(attached: DataFrame) -> DataFrame:
    """The resolution log of identifiers that were offered and not rejected."""
    taken = F.concat("scheme", F.lit(":"), "value", F.lit(" already belongs to canonical entity "), "owner", F.lit("; conflicting attachment was not merged"))
    conflict = F.col("status") == "REVIEW_REQUIRED"
    reason = (
        F.when(conflict, taken).when(F.col("status") == "EXISTING", "authoritative identifier already attached to this canonical entity")
        .otherwise("authoritative identifier attached through canonical ingestion"))
    rows = attached.filter("status != 'REJECTED'").select(
        "run_id", "seq", identifier_key().alias("candidate_key"), F.lit("IDENTIFIER").alias("candidate_type"), F.when(conflict, F.col("owner")).otherwise(F.col("entity_id")).alias("proposed_entity_id"),
        F.when(conflict, "REVIEW_REQUIRED").when(F.col("status") == "EXISTING", "RESOLVED").otherwise("CREATED").alias("status"),
        F.when(conflict, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.array(reason).alias("reasons"))
    return last_wins(with_resolution_id(rows), "id")


def identifier_key() -> Column:
    """An offered identifier's candidate key: the given one, else agent:scheme:value."""
    return F.coalesce("candidate_key", F.concat_ws(":", "source_agent", "scheme", "value"))


def identifier_conflicts(attached: DataFrame) -> DataFrame:
    """Cases for identifiers that another entity owns: the identifier stays where it is and a person decides."""
    rows = attached.filter("status = 'REVIEW_REQUIRED'")
    name = F.concat_ws(":", "scheme", "value")
    match = F.create_map(F.lit("kind"), F.lit("AUTHORITATIVE_IDENTIFIER"), F.lit("scheme"), F.col("scheme"), F.lit("value"), F.col("value"), F.lit("entityId"), F.col("owner"))
    against = F.create_map(F.lit("kind"), F.lit("ENTITY_OWNERSHIP_CONFLICT"), F.lit("existingEntityId"), F.col("owner"), F.lit("proposedEntityId"), F.col("entity_id"))
    return resolution_cases(rows.select(
        "seq", "source_provider", name.alias("source_identifier"), identifier_key().alias("candidate_key"), F.col("owner").alias("existing_entity_id"), F.col("source_id").alias("source_document_id"),
        F.lit("REVIEW_REQUIRED").alias("status"), F.lit(1.0).alias("score"), F.array(match).alias("matching_evidence"), F.array(against).alias("conflicting_evidence"),
        F.concat(name, F.lit(" already belongs to canonical entity "), "owner", F.lit("; conflicting attachment was not merged")).alias("reason")))


def attach_identifiers(candidates: DataFrame, owners: DataFrame) -> DataFrame:
    """candidates (seq, valid, entity_id, source_id, scheme, value) with status and owner.

    The owner of an identifier is its entity before the run or else that of the first candidate that may attach it.
    """
    able = F.col("valid") & F.col("entity_id").isNotNull() & F.col("source_id").isNotNull()
    known = owners.groupBy("scheme", "value").agg(F.min("entity_id").alias("entity_id")).select("scheme", "value", "entity_id", F.lit(-1).cast("long").alias("seq"))
    first = candidates.filter(able).select("scheme", "value", "entity_id", "seq").unionByName(known).groupBy("scheme", "value").agg(F.min_by("entity_id", "seq").alias("owner"), F.min("seq").alias("since"))
    joined = candidates.join(first, ["scheme", "value"], "left")
    status = F.when(~F.coalesce(able, F.lit(False)), "REJECTED").when(F.col("owner") != F.col("entity_id"), "REVIEW_REQUIRED").when(F.col("since") < F.col("seq"), "EXISTING").otherwise("ATTACHED")
    return joined.withColumn("status", status).drop("since")


def case_id(provider: Column, key: Column, entity: Column) -> Column:
    return stable_id("resolution-case", provider, key, entity)


def resolution_cases(records: DataFrame) -> DataFrame:
    """Review queue: (source_provider, candidate_key, existing_entity_id, status, score, reason, seq ...), the last record of a case wins but for when and where it came from."""
    rows = records.withColumn("id", case_id(F.col("source_provider"), F.col("candidate_key"), F.col("existing_entity_id")))
    kept = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "seq").alias("r"), F.min_by(F.struct("seq", "source_provider", "source_identifier"), "seq").alias("f"))
    return kept.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns if c not in ("seq", "source_provider", "source_identifier")], F.col("f.seq").alias("created_seq"), F.col("r.seq").alias("updated_seq"), F.col("f.source_provider").alias("source_provider"), F.col("f.source_identifier").alias("source_identifier"))


def list_cases(cases: DataFrame, status: str | None = None) -> DataFrame:
    rows = cases if status is None else cases.filter(F.col("status") == status)
    return rows.orderBy(F.desc("updated_seq"), "id")


def set_case_status(cases: DataFrame, statuses: DataFrame) -> DataFrame:
    """statuses (id, status) laid over the cases."""
    new = statuses.groupBy("id").agg(F.max("status").alias("_new"))
    return cases.join(new, "id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def resolution_decisions(decisions: DataFrame) -> DataFrame:
    """(case_id, decision_type, decision_actor, reason, seq): the first of equal decisions."""
    return first_wins(decisions.withColumn("id", stable_id("resolution-decision", F.col("case_id"), F.col("decision_type"), F.col("decision_actor"), F.col("reason"))), "id")


def apply_resolution_decisions(decisions: DataFrame, entities: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with reason): a decision needs a valid candidate, a target that exists, a source that
    resolves if one is named, and no identifier that another entity owns.
    """
    target = entities.select(F.col("entity_id").alias("existing_entity_id"), F.lit(True).alias("_target")).distinct()
    ids = decisions.select("seq", "existing_entity_id", F.explode("identifiers").alias("i")).select("seq", "existing_entity_id", F.col("i.scheme").alias("scheme"), F.col("i.value").alias("value"))
    clash = ids.join(owners, ["scheme", "value"]).filter("entity_id != existing_entity_id").groupBy("seq").agg(F.min(F.concat_ws(":", "scheme", "value")).alias("_clash"))
    rows = decisions.join(target, "existing_entity_id", "left").join(clash, "seq", "left")
    reason = (
        F.when(~F.col("valid"), "candidate is invalid").when(F.col("_target").isNull(), "resolution target not found")
        .when(F.col("names_source") & F.col("source_id").isNull(), "resolution source document could not be resolved").when(F.col("_clash").isNotNull(), F.concat("_clash", F.lit(" belongs to another entity")))
    )
    rows = rows.withColumn("quarantine_reason", reason).drop("_target", "_clash")
    return rows.filter("quarantine_reason is null").drop("quarantine_reason"), rows.filter("quarantine_reason is not null")


def decision_key() -> Column:
    """A decision's candidate key: the given one, else agent:type:identifiers."""
    return F.coalesce("candidate_key", F.concat_ws(":", "source_agent", "entity_type", identifier_list(F.col("identifiers"))))


def decision_log(decisions: DataFrame) -> DataFrame:
    """What the resolution log gets of decisions: the last per run, key, entity and status."""
    rows = decisions.select(
        "run_id", "seq", decision_key().alias("candidate_key"), F.lit("ENTITY").alias("candidate_type"), F.col("existing_entity_id").alias("proposed_entity_id"), "status",
        F.col("score").alias("confidence"), F.array("reason").alias("reasons"))
    return last_wins(with_resolution_id(rows), "id")


def resolution_records(accepted: DataFrame) -> dict[str, DataFrame]:
    """What accepted decisions (run_id, seq, candidate fields, existing_entity_id, status, score, reason, decision_actor,
    source_provider, source_identifier) leave behind: cases, decisions, resolutions, run_keys, and the candidates that
    enrich_entities, save_identifiers, alias_candidates and entity evidence take.
    """
    rows = accepted.withColumn("candidate_key", decision_key())
    case = case_id(F.col("source_provider"), F.col("candidate_key"), F.col("existing_entity_id"))
    decided = rows.select(case.alias("case_id"), F.col("status").alias("decision_type"), "decision_actor", "reason", "seq")
    return {
        "cases": resolution_cases(rows), "decisions": resolution_decisions(decided), "resolutions": decision_log(rows),
        "run_keys": rows.select("run_id", "candidate_key", F.col("existing_entity_id").alias("entity_id")).distinct(),
        "candidates": rows.withColumn("entity_id", F.col("existing_entity_id")).withColumn("confidence", F.col("score")),
    }


def record_unresolved(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, resolutions): REVIEW_REQUIRED and NO_MATCH decisions become cases and log entries and change no entity."""
    rows = decisions.filter(F.col("status").isin("REVIEW_REQUIRED", "NO_MATCH")).withColumn("candidate_key", decision_key())
    return resolution_cases(rows), decision_log(rows)


def resolve_person_for_issuer(mentions: DataFrame, people: DataFrame, edges: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """mentions (mention_id, name, issuer_id) with person_id where exactly one person of the issuer fits.

    A person fits by an equal normalised name, or by the first initial and the last word of a name of two words or more;
    a mention meets only people of the issuer that share one of both, and of these just the least and the greatest id,
    so that large groups of people and mentions are not paired.
    """
    def words(c: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(F.lower(normalize_name(c)), "[^a-z0-9 ]", ""), " +"), lambda w: w != "")

    def keys(name: Column, w: Column, least: int) -> Column:
        """What two names that fit have in common: the name as a whole, or initial and last word."""
        initials = F.when(F.size(w) >= least, F.concat_ws(" ", F.lit("i"), F.substring(F.get(w, F.lit(0)), 1, 1), F.element_at(w, -1)))
        return F.explode(F.array_compact(F.array(F.concat(F.lit("n "), name), initials))).alias("_key")

    at = edges.filter(F.col("predicate").isin(*predicates)).select(F.col("subject_entity_id").alias("person_id"), F.col("object_entity_id").alias("issuer_id")).distinct()
    known = people.filter("entity_type = 'PERSON'").select(F.col("id").alias("person_id"), keys(F.lower("canonical_name"), words(F.col("canonical_name")), 1))
    asked = mentions.select("mention_id", "issuer_id", keys(F.lower(normalize_name(F.col("name"))), words(F.col("name")), 2))
    ends = F.min("person_id").alias("person_id"), F.max("person_id").alias("last")  # one and the same where exactly one fits
    groups = at.join(known, "person_id").groupBy("issuer_id", "_key").agg(*ends)
    fits = asked.join(groups, ["issuer_id", "_key"])
    return fits.groupBy("mention_id").agg(F.min("person_id").alias("person_id"), F.max("last").alias("last")).filter("person_id = last").drop("last")


def entity_identity(entities: DataFrame, identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with their sorted identifiers and aliases."""
    ids = identifiers.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.struct("scheme", "value"))).alias("identifiers"))
    names = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return entities.join(ids, "entity_id", "left").join(names, "entity_id", "left")
