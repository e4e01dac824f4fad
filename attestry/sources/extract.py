"""Subsidiaries out of the tables of filing HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import decode_html, strip_html
from .staging import in_order, stage

#: Fixed value: rows that begin like this are headers.
HEADER = "(?i)^(name|subsidiar|jurisdiction|state or country|place of incorporation)"


def parse_subsidiaries(filings: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, pos, name, jurisdiction, evidence) of the rows of all tables; header rows and nameless rows are left out."""
    rows = filings.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit("(?is)<tr\\b[^>]*>(.*?)</tr>"), 1)).alias("pos", "row"))
    cells = rows.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("row", F.lit("(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>"), 1)).alias("at", "cell"))
    clean = cells.withColumn("cell", strip_html(F.col("cell"))).filter("cell != ''")
    # a row's few cells are put together again by its key
    whole = clean.groupBy("doc_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cell"))), lambda x: x["cell"]).alias("cells"))
    name = F.element_at("cells", 1)
    good = whole.filter(~F.array_join("cells", " ").rlike(HEADER) & (F.length(name) >= 2) & ~name.rlike("^[0-9]+$"))
    return good.select("doc_id", "pos", decode_html(name).alias("name"), decode_html(F.try_element_at("cells", F.lit(2))).alias("jurisdiction"), F.array_join("cells", " — ").alias("evidence"))


def unique_subsidiaries(rows: DataFrame) -> DataFrame:
    """The first row of each name, in lower case, within a document."""
    return rows.groupBy("doc_id", F.lower("name").alias("_k")).agg(F.min_by(F.struct(*rows.columns), "pos").alias("r")).select("r.*")


def filing_candidates(filings: DataFrame, run_id: str, id_col: str = "doc_id", html_col: str = "html") -> dict[str, DataFrame]:
    """Candidates out of filings: a source and a filer per document, an entity and a SUBSIDIARY_OF edge per subsidiary.

    Identifiers are scoped to the document, since a name alone never merges. seq follows document and place.
    """
    docs = filings.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html"))
    rows = stage(unique_subsidiaries(parse_subsidiaries(docs)), "subsidiaries")
    null = F.lit(None).cast("string")
    common = {"run_id": F.lit(run_id), "source_agent": F.lit("filings")}

    def identifier(value: Column) -> Column:
        rest = [null.alias(n) for n in ("jurisdiction", "source_document_id", "valid_from", "valid_to")]
        return F.array(F.struct(F.lit("INTERNAL").alias("scheme"), value.alias("value"), *rest, F.lit(None).cast("map<string,string>").alias("attributes")))

    def ref(value: Column) -> Column:
        return F.struct(null.alias("entity_id"), null.alias("candidate_key"), identifier(value).alias("identifiers"), null.alias("canonical_name"), null.alias("entity_type"))

    filer, own = F.concat(F.lit("filing:"), "doc_id"), F.concat(F.lit("filing:"), "doc_id", F.lit(":"), "pos")
    source = F.struct(null.alias("source_document_id"), F.lit("FILINGS").alias("provider"), F.col("doc_id").cast("string").alias("external_id"), null.alias("sha256"))
    proof = F.struct(F.col("evidence").alias("excerpt"), F.lit("FIRST_PARTY").alias("evidence_class"), F.lit(None).cast("map<string,string>").alias("fields"))
    sources = docs.withColumns(common | {
        "provider": F.lit("FILINGS"), "document_type": F.lit("EXHIBIT"), "external_id": F.col("doc_id").cast("string"), "source_url": filer, "sha256": F.sha2("html", 256),
        "evidence_class": F.lit("FIRST_PARTY")})
    firm = common | {"entity_type": F.lit("COMPANY")}
    filers = docs.select("doc_id", F.lit(-1).alias("pos"), null.alias("jurisdiction")).withColumns(firm | {"candidate_key": filer, "canonical_name": filer, "identifiers": identifier(filer)})
    firms = rows.withColumns(firm | {"candidate_key": own, "canonical_name": F.col("name"), "identifiers": identifier(own)})
    edges = rows.withColumns(common | {
        "subject": ref(own), "predicate": F.lit("SUBSIDIARY_OF"), "object": ref(filer), "source_document": source, "evidence": proof, "extraction_method": F.lit("TABLE"),
        "assertion_type": F.lit("REPORTED"), "confidence": F.lit(1.0), "source_record_id": F.col("pos").cast("string")})
    columns = ["doc_id", "pos", "run_id", "source_agent", "candidate_key", "entity_type", "canonical_name", "identifiers", "jurisdiction"]
    return {
        "sources": in_order(sources.drop("html"), ["doc_id"], "filings"), "entities": in_order(filers.select(columns).unionByName(firms.select(columns)), ["doc_id", "pos"], "firms"),
        "relationships": in_order(edges, ["doc_id", "pos"], "subsidiary-edges")}
