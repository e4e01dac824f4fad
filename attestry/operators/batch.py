"""A whole batch of candidates into canonical tables: sources, entities, identifiers, relationships, events, claims, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stable_id
from ..schemas import conform
from ..sources.staging import in_order, stage
from . import ingest as I
from . import resolve as R
from . import survivorship as S
from . import validate as V
from .references import resolve_refs, with_sources

#: Candidate kinds in the order in which a batch is taken: name in results, validator.
KINDS = {
    "sources": ("SOURCE", V.validate_sources), "entities": ("ENTITY", V.validate_entities), "identifiers": ("IDENTIFIER", V.validate_identifiers),
    "relationships": ("RELATIONSHIP", V.validate_relationships), "events": ("EVENT", V.validate_events), "claims": ("CLAIM", V.validate_claims),
}
ENTITY_COLUMNS = {
    "entity_type": "string", "canonical_name": "string", "identifiers": None, "aliases": "array<string>", "jurisdiction": "string", "status": "string", "attributes": "map<string,string>",
    "confidence": "double",
}


class Known:
    """What references can be resolved by, growing as the kinds of a batch are taken."""

    def __init__(self, sources: DataFrame, entity_ids: DataFrame, run_keys: DataFrame, owners: DataFrame) -> None:
        self.sources, self.entity_ids, self.run_keys, self.owners = sources, entity_ids, run_keys, owners
        self.stubs: list[tuple[int, DataFrame]] = []

    def context(self) -> I.Context:
        return self.sources, self.entity_ids, self.run_keys, self.owners

    def add(self, stubs: DataFrame | None, phase: int) -> None:
        """Entities that the references of one kind made are known to later kinds."""
        if stubs is None:
            return
        self.stubs.append((phase, stubs))
        made = stubs.filter("entity_id is not null")
        self.entity_ids = self.entity_ids.unionByName(made.select("entity_id"))
        self.run_keys = self.run_keys.unionByName(made.select("run_id", "candidate_key", "entity_id"))
        self.owners = stage(self.owners.unionByName(S.save_identifiers(made).join(self.owners, ["scheme", "value"], "left_anti").select("scheme", "value", "entity_id")), "owners")


def entity_rows(kept: DataFrame, stubs: list[tuple[int, DataFrame]]) -> DataFrame:
    """What entities are made of, in order: candidates that were kept, then stubs, kind by kind."""
    kept = kept.select("entity_id", "run_id", F.lit(0).alias("phase"), F.col("seq").alias("at"), F.lit(0).cast("long").alias("pos"), *ENTITY_COLUMNS)
    parts = [kept]
    for phase, s in stubs:
        made = s.filter("entity_id is not null")
        more = {c: F.lit(None).cast(t) for c, t in ENTITY_COLUMNS.items() if c not in s.columns}
        sure = F.when(S.first_authoritative(F.col("identifiers")).isNotNull(), 1.0).otherwise(0.8)
        parts.append(made.withColumns(more | {"confidence": sure, "phase": F.lit(phase), "at": F.col("seq"), "pos": F.col("pos").cast("long")}).select(kept.columns))
    return in_order(I.union(parts), ["phase", "at", "pos"], "entity-rows")


def attach(offered: DataFrame, known: Known) -> tuple[DataFrame, DataFrame | None]:
    """(attached, stubs): checked identifier candidates with entity, source, owner, status and what they lack."""
    good, bad = stage(offered.filter("valid"), "offered"), offered.filter("not valid")
    found, stubs = resolve_refs(good, {"entity_id": "entity"}, known.entity_ids, known.run_keys, known.owners)
    known.add(stubs, 1)
    placed = with_sources(found, known.sources).unionByName(bad, allowMissingColumns=True)
    lacking = V.reasons_of((F.col("valid") & F.col("entity_id").isNull(), "entity could not be resolved"), (F.col("valid") & F.col("source_id").isNull(), "source document could not be resolved"))
    named = placed.withColumns({"scheme": F.col("identifier.scheme"), "value": F.col("identifier.value"), "unresolved": lacking})
    return stage(R.attach_identifiers(named, known.owners), "attached"), stubs


def entity_evidence(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence of candidates that were kept and bring some along."""
    own = with_sources(entities.filter("entity_id is not null and evidence is not null and coalesce(extraction_method, '') != ''"), sources)
    own = own.filter("source_id is not null").withColumns({
        "source_document_id": F.col("source_id"), "evidence_class": F.col("evidence.evidence_class"), "excerpt": F.col("evidence.excerpt"),
        "assertion_type": F.coalesce("assertion_type", F.lit("ASSERTED")), "confidence": F.coalesce("given_confidence", F.lit(1.0)),
        "said": I.with_entries(I.given_map("evidence.fields"), sourceRecordId=F.col("source_record_id"), sourceAgent=F.col("source_agent"))})
    return I.evidence_rows(own, "ENTITY", "entity_id", "excerpt", "said")


def identifier_evidence(attached: DataFrame) -> DataFrame:
    fields = I.merged(I.given_map("identifier.attributes"), I.given_map("evidence.fields"))
    tied = attached.filter("status in ('ATTACHED', 'EXISTING')").withColumns({
        "identifier_id": stable_id("identifier", F.col("scheme"), F.col("value"), F.col("identifier.jurisdiction")), "source_document_id": F.col("source_id"),
        "evidence_class": F.col("evidence.evidence_class"), "excerpt": F.col("evidence.excerpt"),
        "said": I.with_entries(fields, sourceRecordId=F.col("source_record_id"), sourceAgent=F.col("source_agent"))})
    return I.evidence_rows(tied, "IDENTIFIER", "identifier_id", "excerpt", "said")


def ingest_batch(batch: dict[str, DataFrame], as_of: str, owners: DataFrame | None = None, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Canonical tables out of a batch: candidates by kind, each with run_id, seq and source_agent.

    owners: scheme, value, entity_id of identifiers that exist already. stored: what else earlier batches left that this
    one may refer to: sources, run_keys (run_id, candidate_key, entity_id), entity_ids (entity_id). References see entities, their identifiers and
    those attached in the same batch, and entities that references of an earlier kind made. Beside the canonical
    tables: rejections, validations, resolutions, cases, and what each run touched (run_sources, run_relationships,
    run_events, run_claims: run_id, id), what entities are made of (entity_rows) and run_keys. Tables of kinds that the batch does not have are left out.
    """
    spark = next(iter(batch.values())).sparkSession
    given = {k: conform(batch[k] if k in batch else spark.createDataFrame([], "run_id string"), k) for k in KINDS}
    checked = {k: stage(check(given[k]), f"checked-{k}") for k, (_, check) in KINDS.items() if k in ("sources", "entities", "identifiers")}
    keyed = R.with_keys(checked["entities"]).select("seq", F.col("candidate_key").alias("validation_key"))
    checked["entities"] = stage(checked["entities"].drop("validation_key").join(keyed, "seq"), "checked-entities")
    checked["identifiers"] = checked["identifiers"].withColumn("validation_key", F.coalesce("candidate_key", F.concat_ws(":", "source_agent", "identifier.scheme", "identifier.value")))

    saved = checked["sources"].filter("valid")
    saved = saved.withColumn("metadata", I.with_entries(I.given_map("metadata"), sourceAgent=F.col("source_agent")))
    sources = stage(S.save_sources(saved, as_of), "sources")
    source_links = saved.select("run_id", stable_id("source", F.col("provider"), F.col("external_id"), F.col("sha256")).alias("id"))

    no_ids = F.array().cast(given["entities"].schema["identifiers"].dataType)
    entities = checked["entities"].filter("valid").withColumn("identifiers", F.coalesce("identifiers", no_ids)).drop("reasons", "valid", "validation_key")
    stored = stored or {}
    resolved = stage(R.resolve_entities(entities, owners, stored.get("run_keys")), "resolved")
    kept = entities.drop("candidate_key").join(resolved.filter("kept").select("seq", "entity_id", "candidate_key"), "seq").withColumn("given_confidence", F.col("confidence"))
    sure = F.coalesce("confidence", F.when(S.first_authoritative(F.col("identifiers")).isNotNull(), 1.0).otherwise(0.8))
    kept = stage(kept.withColumn("confidence", sure), "kept")
    nameless = resolved.filter("status = 'REJECTED'").select("seq")
    unnamed = checked["entities"].join(nameless, "seq").withColumns({
        "valid": F.lit(False), "reasons": F.array(F.lit("canonical name is required when no authoritative identifier resolves"))})

    mine = S.save_identifiers(kept).select("scheme", "value", "entity_id")
    before = [] if owners is None else [owners.select("scheme", "value", "entity_id")]
    ids = I.union([kept.select("entity_id"), *(o.select("entity_id") for o in [*before, *(stored[k] for k in ("entity_ids",) if k in stored)])]).distinct()
    run_keys = resolved.filter("entity_id is not null").select("run_id", "candidate_key", "entity_id").distinct()
    if "run_keys" in stored:
        run_keys = run_keys.unionByName(stored["run_keys"].select("run_id", "candidate_key", "entity_id")).distinct()
    known_sources = sources
    if "sources" in stored:  # the stored version of a source stands
        about = ["id", "provider", "external_id", "sha256", "retrieved_at", "source_url", "published_at", "filed_at"]
        known_sources = stage(stored["sources"].select(*about).unionByName(sources.join(stored["sources"].select("id"), "id", "left_anti").select(*about)), "known-sources")
    known = Known(known_sources, stage(ids, "entity-ids"), stage(run_keys, "run-keys"), stage(I.union([*before, mine]), "owners"))

    # a kind that the batch doesn't have costs nothing
    attached = attach(checked["identifiers"], known)[0] if "identifiers" in batch else None
    told = {}
    if attached is not None:
        fresh = attached.filter("status = 'ATTACHED'")
        known.owners = stage(known.owners.unionByName(fresh.select("scheme", "value", "entity_id")), "owners")
    for phase, (kind, take) in enumerate((("relationships", I.ingest_relationships), ("events", I.ingest_events), ("claims", I.ingest_claims)), 2):
        if kind in batch:
            told[kind] = take(given[kind], *known.context(), as_of=as_of)
            known.add(told[kind]["stubs"], phase)

    rows = entity_rows(kept, known.stubs)
    all_ids = rows
    if attached is not None:
        tied = fresh.select("entity_id", F.lit(1).alias("phase"), F.col("seq").alias("at"), F.lit(-1).cast("long").alias("pos"), F.array("identifier").alias("identifiers"))
        all_ids = in_order(rows.select("entity_id", "phase", "at", "pos", "identifiers").unionByName(tied), ["phase", "at", "pos"], "identifier-rows")
    proof = [entity_evidence(kept, known_sources)] + ([] if attached is None else [identifier_evidence(attached)])
    proof += [I.evidence_rows(told[k]["all"], KINDS[k][0], excerpt="excerpt" if k == "claims" else "evidence") for k in told]
    evidence = S.first_wins(stage(I.union(proof), "evidence"), "id")

    late = lambda df, n: df.withColumn("late", F.lit(n))
    results = [late(V.validation_results(df, KINDS[k][0]), 0) for k, df in checked.items()]
    rejected = [V.rejection_rows(df, KINDS[k][0]) for k, df in checked.items()] + [V.rejection_rows(unnamed, "ENTITY")]
    logged, touched = [R.resolution_log(entities, resolved)], [source_links]
    if attached is not None:
        lost = attached.filter("valid and size(unresolved) > 0").withColumns({"reasons": F.col("unresolved"), "valid": F.lit(False)}).select(*checked["identifiers"].columns)
        results.append(late(V.validation_results(lost, "IDENTIFIER"), 1))
        rejected.append(V.rejection_rows(lost, "IDENTIFIER"))
        logged.append(R.attachment_log(attached))
        touched.append(attached.filter("status in ('ATTACHED', 'EXISTING')").select("run_id", F.col("source_id").alias("id")))
    for _, s in known.stubs:
        results.append(late(V.validation_results(s.withColumn("validation_key", F.col("candidate_key")), "ENTITY"), 0))
        rejected.append(V.rejection_rows(s.drop("n", "pos", "entity_id"), "ENTITY"))
        logged.append(R.stub_log(s))
    for found in told.values():
        results.append(found["validations"])
        rejected.append(found["rejected"])
        touched.append(found["links"]["sources"])
    out = {
        "sources": sources, "entities": S.merge_entities(rows), "identifiers": S.save_identifiers(all_ids), "aliases": S.save_aliases(rows), "evidence": evidence,
        "rejections": S.first_wins(stage(I.union(rejected), "rejected"), "id"), "validations": V.validation_log(stage(I.union(results), "results")),
        "resolutions": S.last_wins(stage(I.union(logged), "logged"), "id"), "run_sources": I.union(touched).distinct(), "entity_rows": rows, "run_keys": known.run_keys.distinct()}
    if attached is not None:
        out |= {"attachments": attached, "cases": R.identifier_conflicts(attached)}
    for kind, found in told.items():
        out |= {kind: found[kind], f"run_{kind}": found["links"]["records"]}
    if "events" in told:
        out["participants"] = told["events"]["participants"]
    if "claims" in told:
        out["facts"] = I.facts_from_claims(told["claims"]["all"])
    return out
