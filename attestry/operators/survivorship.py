"""Which record of a key survives. Every input carries `seq`, the caller's total order of ingestion.

Only keys and their order are aggregated, by hash and before the shuffle; whole rows stay where they are unless very
many keys are repeated. A frame that costs much to compute should be staged first, as it is read twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_name, normalized_alias, stable_id
from ..functions.vocabulary import AUTHORITATIVE_SCHEMES
from ..sources.staging import small


def first_wins(df: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """The first row of each key; of rows that tie, one."""
    return _one(df, key, order, F.min)


def last_wins(df: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """The last row of each key; of rows that tie, one."""
    return _one(df, key, order, F.max)


def _one(df: DataFrame, key: tuple[str, ...], order: str, pick) -> DataFrame:
    best = df.groupBy(*key).agg(pick(order).alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
    again = small(best.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(key)], "_best", F.lit(True).alias("_hit")), "repeated")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(key)])
    marked = df.join(again, same, "left").withColumn("_again", F.col("_hit").isNotNull())
    chosen = marked.filter("_again").filter(F.col(order).eqNullSafe(F.col("_best"))).dropDuplicates(list(key))
    return marked.filter("not _again").select(*df.columns).unionByName(chosen.select(*df.columns))


def last_known(c: str, order: str = "seq") -> Column:
    """The latest value that is not null."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def first_known(c: str, order: str = "seq") -> Column:
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def upgraded_type(order: str = "seq") -> Column:
    """The first type, but an organization that was ever called a company is one."""
    first = F.min_by("entity_type", order)
    return F.when((first == "ORGANIZATION") & F.bool_or(F.col("entity_type") == "COMPANY"), "COMPANY").otherwise(first)


def merge_attributes(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """(key, attributes): the latest value of each attribute; an explicit null overwrites."""
    each = df.select(key, order, F.explode("attributes").alias("k", "v"))
    last = each.groupBy(key, "k").agg(F.max_by(F.struct("v"), order).alias("v"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v.v")))).alias("attributes"))


def save_sources(sources: DataFrame, as_of: str) -> DataFrame:
    """Source documents by (provider, external id, hash); the first one wins."""
    rows = sources.withColumns({
        "id": stable_id("source", F.col("provider"), F.col("external_id"), F.col("sha256")),
        "retrieved_at": F.coalesce("retrieved_at", F.lit(as_of)),
        "evidence_class": F.coalesce("evidence_class", F.when(F.col("provider") == "SEC", "OFFICIAL_RECORD").otherwise("FIRST_PARTY")),
    })
    return first_wins(rows, "id")


def merge_entities(candidates: DataFrame) -> DataFrame:
    """One row per entity_id of accepted candidates (entity_id, entity_type, canonical_name, jurisdiction, status, confidence, attributes, seq)."""
    named = candidates.withColumn("canonical_name", normalize_name(F.col("canonical_name")))
    rows = named.groupBy("entity_id").agg(
        last_known("canonical_name").alias("canonical_name"), upgraded_type().alias("entity_type"), last_known("jurisdiction").alias("jurisdiction"),
        F.coalesce(F.min_by("status", "seq"), F.lit("ACTIVE")).alias("status"), F.min_by("confidence", "seq").alias("resolution_confidence"),
        F.min("seq").alias("created_seq"), F.max("seq").alias("updated_seq"))
    return rows.join(merge_attributes(candidates, "entity_id"), "entity_id", "left")


def entity_states(rows: DataFrame, batch: int = 0, enriching: bool = False) -> DataFrame:
    """What candidates (as merge_entities takes them) do to each entity, as aggregates that merge_states puts together.

    Each value carries where it came from (batch and seq). enriching: resolved candidates, as enrich_entities takes
    them: they name nothing, fill in a jurisdiction only where there is none and raise the confidence.
    """
    at = F.struct(F.lit(batch).cast("long").alias("batch"), F.col("seq").cast("long").alias("n"))
    said = lambda c: F.struct(at.alias("at"), c.alias("v"))
    known = lambda c: F.when(c.isNotNull(), said(c))
    nothing = lambda c: F.when(F.lit(False), said(c))
    name, place, sure = normalize_name(F.col("canonical_name")), F.col("jurisdiction"), F.col("confidence")
    pick = nothing if enriching else known
    each = rows.select(
        "entity_id", pick(name).alias("name"), (nothing if enriching else said)(F.col("entity_type")).alias("kind"), (F.col("entity_type") == "COMPANY").alias("company"), pick(place).alias("place"),
        (known if enriching else nothing)(place).alias("filled"), (nothing if enriching else said)(F.col("status")).alias("status"), (nothing if enriching else said)(sure).alias("sure"),
        (sure if enriching else F.lit(None).cast("double")).alias("raised"), nothing(F.lit("")).getField("at").alias("created") if enriching else at.alias("created"), at.alias("updated"),
        F.transform_values("attributes", lambda k, v: said(v)).alias("attributes"))
    return merge_states(each)


def merge_states(states: DataFrame) -> DataFrame:
    """One state per entity; the order in which states are put together does not matter."""
    merged = states.groupBy("entity_id").agg(
        F.max("name").alias("name"), F.min("kind").alias("kind"), F.bool_or("company").alias("company"), F.max("place").alias("place"), F.min("filled").alias("filled"),
        F.min("status").alias("status"), F.min("sure").alias("sure"), F.max("raised").alias("raised"), F.min("created").alias("created"), F.max("updated").alias("updated"))
    each = states.select("entity_id", F.explode("attributes").alias("k", "x")).groupBy("entity_id", "k").agg(F.max("x").alias("x"))
    attributes = each.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "x")))).alias("attributes"))
    return merged.join(attributes, "entity_id", "left")


def finished_entities(states: DataFrame) -> DataFrame:
    """Entities out of their states: as merge_entities gives them, with created and updated (batch, n) for the seqs."""
    kind = F.when((F.col("kind.v") == "ORGANIZATION") & F.col("company"), "COMPANY").otherwise(F.col("kind.v"))
    return states.select(
        "entity_id", F.col("name.v").alias("canonical_name"), kind.alias("entity_type"), F.coalesce("place.v", "filled.v").alias("jurisdiction"), F.coalesce("status.v", F.lit("ACTIVE")).alias("status"),
        F.greatest("sure.v", "raised").alias("resolution_confidence"), "created", "updated", F.transform_values("attributes", lambda k, x: x["v"]).alias("attributes"))


def enrich_entities(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities with resolved candidates laid over: the name stays, jurisdiction is kept where known, confidence rises."""
    own = entities.select("entity_id", "entity_type", "canonical_name", "jurisdiction", F.col("resolution_confidence").alias("confidence"), "attributes", F.lit(-1).cast("long").alias("seq"))
    rows = own.unionByName(decisions.select(own.columns).join(own.select("entity_id"), "entity_id", "left_semi"))
    merged = rows.groupBy("entity_id").agg(F.min_by("canonical_name", "seq").alias("canonical_name"), upgraded_type().alias("entity_type"), first_known("jurisdiction").alias("jurisdiction"), F.max("confidence").alias("resolution_confidence"))
    return merged.join(merge_attributes(rows, "entity_id"), "entity_id", "left")


def alias_candidates(decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """A resolved candidate's aliases, and its name where that is another one than the entity's."""
    named = decisions.join(entities.select("entity_id", F.col("canonical_name").alias("_now")), "entity_id")
    other = F.when(F.lower(normalize_name(F.col("canonical_name"))) != F.lower("_now"), F.array("canonical_name"))
    return named.withColumn("aliases", F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce(other, F.array().cast("array<string>")))).drop("_now")


def save_identifiers(candidates: DataFrame) -> DataFrame:
    """(id, entity_id, scheme, value, jurisdiction): the first owner of scheme:value:jurisdiction keeps it."""
    each = candidates.select("entity_id", "seq", F.posexplode("identifiers").alias("pos", "i")).select("entity_id", "seq", "pos", F.col("i.scheme").alias("scheme"), F.col("i.value").alias("value"), F.col("i.jurisdiction").alias("jurisdiction"))
    each = each.withColumn("id", stable_id("identifier", F.col("scheme"), F.col("value"), F.col("jurisdiction"))).withColumn("at", F.struct("seq", "pos"))
    return first_wins(each, "id", order="at").drop("at", "seq", "pos")


def save_aliases(candidates: DataFrame) -> DataFrame:
    """(id, entity_id, alias, normalized): the first spelling of each normalised alias."""
    each = candidates.select("entity_id", "seq", F.posexplode("aliases").alias("pos", "alias")).withColumn("normalized", normalized_alias(F.col("alias")))
    each = each.filter("alias is not null").withColumn("at", F.struct("seq", "pos")).withColumn("id", stable_id("alias", F.col("entity_id"), F.col("normalized")))
    return first_wins(each, "id", order="at").drop("at", "seq", "pos")


def first_authoritative(ids: Column) -> Column:
    """The first identifier of an authoritative scheme, or null."""
    return F.try_element_at(F.filter(ids, lambda i: i["scheme"].isin(*AUTHORITATIVE_SCHEMES)), F.lit(1))
