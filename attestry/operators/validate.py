"""Validation: each rule of a candidate gives a reason; a candidate without reasons is valid. Rule order is part of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import identifier_list, is_blank, stable_id
from ..functions.vocabulary import ASSERTION_TYPES, ENTITY_TYPES, EVIDENCE_CLASSES, VALIDATOR_VERSION
from .survivorship import first_wins, last_wins

Rule = tuple[Column, str]


def reasons_of(*rules: Rule) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(text)) for broken, text in rules]))


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _no_source(ref: str) -> Column:
    return _missing(F.col(f"{ref}.source_document_id")) & (_missing(F.col(f"{ref}.provider")) | _missing(F.col(f"{ref}.external_id")))


def _outside(c: str) -> Column:
    return ~F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1), F.lit(False))


def _not_in(c: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def evidence_rules() -> list[Rule]:
    return [
        (_outside("confidence"), "confidence must be between 0 and 1"),
        (is_blank(F.col("extraction_method")), "extraction method is required"),
        (is_blank(F.col("evidence.excerpt")), "evidence excerpt is required"),
        (_not_in("evidence.evidence_class", EVIDENCE_CLASSES), "recognized evidence class is required"),
        (_not_in("assertion_type", ASSERTION_TYPES), "recognized assertion type is required"),
        (_no_source("source_document"), "source document reference is required"),
    ]


def _checked(df: DataFrame, reasons: Column, key: Column) -> DataFrame:
    return df.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0).withColumn("validation_key", key)


def validate_evidence(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", reasons_of(*evidence_rules()))


def validate_sources(df: DataFrame) -> DataFrame:
    reasons = reasons_of(
        (is_blank(F.col("provider")), "provider is required"), (is_blank(F.col("document_type")), "document type is required"), (is_blank(F.col("external_id")), "external ID is required"),
        (is_blank(F.col("source_url")), "source URL is required"), (~F.coalesce(F.col("sha256").rlike("^[A-Fa-f0-9]{64}\\z"), F.lit(False)), "SHA-256 must be a 64-character hex digest"),
        (_not_in("evidence_class", EVIDENCE_CLASSES), "recognized evidence class is required"))
    return _checked(df, reasons, F.concat_ws(":", F.coalesce("provider", F.lit("")), F.coalesce("external_id", F.lit(""))))


def _identifier_reasons(ids: Column) -> Column:
    """Per identifier: blank, then repeated; reasons repeat as often as they hold."""
    keys = F.transform(ids, lambda i: F.concat_ws(":", *[F.coalesce(i[f], F.lit("")) for f in ("scheme", "value", "jurisdiction")]))
    blank, again = F.lit("identifier scheme and value are required"), F.lit("duplicate identifier in entity candidate")

    def one(i: Column, at: Column) -> Column:
        return F.array_compact(F.array(F.when(is_blank(i["scheme"]) | is_blank(i["value"]), blank), F.when(F.array_contains(F.slice(keys, F.lit(1), at), F.get(keys, at)), again)))

    return F.coalesce(F.flatten(F.transform(ids, one)), F.array().cast("array<string>"))


def validate_entities(df: DataFrame) -> DataFrame:
    ids = F.coalesce("identifiers", F.array().cast(df.schema["identifiers"].dataType))
    asserted = F.col("evidence").isNotNull() | ~_missing(F.col("extraction_method")) | ~_missing(F.col("assertion_type"))
    head = reasons_of(
        (_not_in("entity_type", ENTITY_TYPES), "recognized entity type is required"), (is_blank(F.col("canonical_name")) & (F.size(ids) == 0), "canonical name or authoritative identifier is required"),
        (is_blank(F.col("source_agent")), "source agent is required"), (F.col("confidence").isNotNull() & _outside("confidence"), "confidence must be between 0 and 1"))
    tail = reasons_of(
        (is_blank(F.col("evidence.excerpt")), "entity evidence excerpt is required"), (_not_in("evidence.evidence_class", EVIDENCE_CLASSES), "recognized entity evidence class is required"),
        (is_blank(F.col("extraction_method")), "entity extraction method is required"), (F.col("assertion_type").isNotNull() & _not_in("assertion_type", ASSERTION_TYPES), "recognized entity assertion type is required"),
        (_no_source("source_document"), "entity source document reference is required"))
    reasons = F.concat(head, _identifier_reasons(ids), F.when(asserted, tail).otherwise(F.array().cast("array<string>")))
    key = F.coalesce("candidate_key", F.concat_ws(":", "entity_type", F.coalesce("canonical_name", identifier_list(ids))))
    return _checked(df, reasons, key)


def validate_identifiers(df: DataFrame) -> DataFrame:
    refs = F.coalesce(F.size("entity.identifiers"), F.lit(0)) > 0
    reasons = reasons_of(
        *evidence_rules(), (is_blank(F.col("source_agent")), "source agent is required"), (_missing(F.col("entity.entity_id")) & ~refs, "resolvable entity reference is required"),
        (is_blank(F.col("identifier.scheme")), "identifier scheme is required"), (is_blank(F.col("identifier.value")), "identifier value is required"))
    return _checked(df, reasons, F.coalesce("candidate_key", F.concat_ws(":", F.coalesce("identifier.scheme", F.lit("")), F.coalesce("identifier.value", F.lit("")))))


def validate_relationships(df: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)  # noqa: E731  NaN compares false here, but is the largest number to Spark
    reasons = reasons_of(
        *evidence_rules(), (is_blank(F.col("predicate")), "predicate is required"), (F.col("subject").isNull() | F.col("object").isNull(), "subject and object are required"),
        (~_missing(F.col("subject.entity_id")) & (F.col("subject.entity_id") == F.col("object.entity_id")), "self-relationship is unsupported"),
        (number("percentage") & ((F.col("percentage") < 0) | (F.col("percentage") > 100)), "percentage must be between 0 and 100"), (number("shares") & (F.col("shares") < 0), "shares cannot be negative"))
    return _checked(df, reasons, F.coalesce("candidate_key", "source_record_id", "predicate"))


def validate_events(df: DataFrame) -> DataFrame:
    reasons = reasons_of(
        *evidence_rules(), (is_blank(F.col("event_type")), "event type is required"), (is_blank(F.col("description")), "description is required"),
        (F.coalesce(F.size("participants"), F.lit(0)) <= 0, "at least one participant is required"), (is_blank(F.col("source_record_id")), "source record ID is required"))
    return _checked(df, reasons, F.coalesce("candidate_key", "source_record_id"))


def validate_claims(df: DataFrame) -> DataFrame:
    reasons = reasons_of(*evidence_rules(), (is_blank(F.col("claim_type")), "claim type is required"), (is_blank(F.col("statement")), "statement is required"))
    return _checked(df, reasons, F.coalesce("candidate_key", "source_record_id", "claim_type"))


def validate_resolved_relationships(df: DataFrame) -> DataFrame:
    """Rules on resolved rows: subject_id, object_id, source_document_id, evidence, and the numbers."""
    out = lambda c: (F.col(c) < 0) | ((F.col(c) > 1) & ~F.isnan(c))
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return df.withColumn("reasons", reasons_of(
        (_missing(F.col("source_document_id")), "missing source document"), (is_blank(F.col("evidence")), "missing supporting evidence"), (_missing(F.col("subject_id")) | _missing(F.col("object_id")), "unresolved entity"),
        (F.col("subject_id").eqNullSafe(F.col("object_id")), "self-relationship is unsupported"), (out("confidence"), "confidence outside [0,1]"), (out("resolution_confidence"), "resolution confidence outside [0,1]"),
        (number("percentage") & ((F.col("percentage") < 0) | (F.col("percentage") > 100)), "percentage outside [0,100]"), (number("shares") & (F.col("shares") < 0), "negative shares"),
        ((F.col("predicate") == "HOLDS_SECURITY") & F.col("evidence").rlike("(?i)paid|payment|treasury|invested into"), "holding is incorrectly described as a payment"))).withColumn("valid", F.size("reasons") == 0)


def validate_resolved_events(df: DataFrame) -> DataFrame:
    """Days up to 31 pass in any month, as in the data's producers."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    date_ok = F.coalesce(F.col("event_date").rlike("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\\z"), F.lit(False))
    return df.withColumn("reasons", reasons_of(
        (_missing(F.col("source_document_id")), "missing source document"), (is_blank(F.col("evidence")), "missing supporting evidence"), (F.col("n_participants") <= 0, "event has no participants"),
        (~date_ok, "invalid event date"), (number("shares") & (F.col("shares") < 0), "negative shares"), (number("price_per_share") & (F.col("price_per_share") < 0), "negative price"),
        (number("confidence") & ((F.col("confidence") < 0) | (F.col("confidence") > 1)), "confidence outside [0,1]"))).withColumn("valid", F.size("reasons") == 0)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter("valid").drop("reasons", "valid"), checked.filter("not valid")


def rejection_rows(checked: DataFrame, candidate_type: str) -> DataFrame:
    """Rejected candidates with their reasons, each time they were rejected."""
    bad = checked.filter("not valid")
    content = F.to_json(F.struct(*[c for c in bad.columns if c not in ("reasons", "valid", "validation_key", "seq", "run_id")]))
    rows = bad.select("run_id", "seq", F.lit(candidate_type).alias("candidate_type"), content.alias("candidate"), "reasons")
    return rows.withColumn("id", stable_id("rejection", F.col("run_id"), F.col("candidate_type"), F.col("candidate"), F.array_join("reasons", "|")))


def rejections(checked: DataFrame, candidate_type: str) -> DataFrame:
    """Rejected candidates with their reasons, once per run and content."""
    return first_wins(rejection_rows(checked, candidate_type), "id")


def validation_results(checked: DataFrame, candidate_type: str) -> DataFrame:
    """Every validation, uncollapsed."""
    rows = checked.select("run_id", "seq", F.lit(candidate_type).alias("candidate_type"), F.col("validation_key").alias("candidate_key"), F.col("valid").alias("is_valid"), "reasons", F.lit(VALIDATOR_VERSION).alias("validator_version"))
    return rows.withColumn("id", stable_id("validation", F.col("run_id"), F.col("candidate_type"), F.col("candidate_key"), F.col("validator_version")))


def validation_log(results: DataFrame) -> DataFrame:
    """The last result per run, type, key and validator version; at one seq, a late one (after failed resolution)."""
    late = F.col("late") if "late" in results.columns else F.lit(0)
    return last_wins(results.withColumn("_order", F.struct("seq", late.alias("late"))), "id", order="_order").drop("_order", "late")
