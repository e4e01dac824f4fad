"""The registered queries over the driver's tables and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.vocabulary import AUTHORITATIVE_SCHEMES, CAREER_PREDICATES, VOCABULARY, classify_predicates
from .operators import ingest as I
from .operators import references as L
from .operators import resolve as R
from .operators import survivorship as S
from .operators import validate as V
from .plans import graph as G
from .schemas import conform
from .sources import binding as B
from .sources import extract as X
from .sources import tables as T
from .sources.staging import n_parts, new_folder, part_of, stage, stage_parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with DuckDB SQL over tables of their own names."""
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = B.plain(sql)
        return f

    return keep


def sid(namespace: str, key: str) -> str:
    """stable_id in SQL."""
    h = f"sha256('{namespace}:' || {key})"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Scalar functions ---------------------------------------------------------------------------------------------------

@query("select c_custkey, sha256(c_name) as h from {customer}")
def sha256_hex(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", C.sha256_hex(F.col("c_name")).alias("h"))


@query(f"select o_orderkey, {sid('source', "o_orderstatus || ':' || o_orderkey || ':'")} as id from {{orders}}")
def stable_id(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", C.stable_id("source", F.col("o_orderstatus"), F.col("o_orderkey"), F.lit(None)).alias("id"))


_NAMES = "select p_partkey, '  ' || p_name || ' &amp;  ' || chr(9) || p_type || ' ' as raw from {part}"
_NORMAL = "trim(regexp_replace(replace(raw, '&amp;', '&'), '[ \\t]+', ' ', 'g'))"


@query(f"select p_partkey, {_NORMAL} as name from ({_NAMES})")
def normalize_name(spark, sf_dir):
    return B.bind(spark, sf_dir, _NAMES).select("p_partkey", C.normalize_name(F.col("raw")).alias("name"))


@query(f"select p_partkey, lower({_NORMAL}) as alias from ({_NAMES})")
def normalized_alias(spark, sf_dir):
    return B.bind(spark, sf_dir, _NAMES).select("p_partkey", C.normalized_alias(F.col("raw")).alias("alias"))


@query(f"select p_partkey, regexp_replace(regexp_replace(replace(lower({_NORMAL}), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from ({_NAMES})")
def company_slug(spark, sf_dir):
    return B.bind(spark, sf_dir, _NAMES).select("p_partkey", C.company_slug(F.col("raw")).alias("slug"))


_CIKS = "select o_orderkey, case when o_orderkey % 9 = 0 then 'none' when o_orderkey % 10 = 0 then '12345678901' else 'CIK ' || o_orderkey || '-' || o_custkey end as raw from {orders}"


@query(f"select o_orderkey, case when length(d) between 1 and 10 then lpad(d, 10, '0') end as cik from (select *, regexp_replace(raw, '[^0-9]', '', 'g') as d from ({_CIKS}))")
def normalize_cik(spark, sf_dir):
    return B.bind(spark, sf_dir, _CIKS).select("o_orderkey", C.normalize_cik(F.col("raw")).alias("cik"))


_ACCESSIONS = "select o_orderkey, lpad(cast(o_custkey as string), case when o_orderkey % 8 = 0 then 9 else 10 end, '0') || '-' || substr(cast(o_orderdate as string), 3, 2) || '-' || lpad(cast(o_orderkey as string), 6, '0') as raw from {orders}"


@query(f"""select o_orderkey, case when ok then substr(d, 1, 10) || '-' || substr(d, 11, 2) || '-' || substr(d, 13, 6) end as accession, case when ok then d end as plain, case when ok then cast(cast(substr(d, 1, 10) as bigint) as varchar) end as filer
    from (select *, length(d) = 18 as ok from (select *, replace(raw, '-', '') as d from ({_ACCESSIONS})))""")
def normalize_accession(spark, sf_dir):
    raw = F.col("raw")
    return B.bind(spark, sf_dir, _ACCESSIONS).select("o_orderkey", C.normalize_accession(raw).alias("accession"), C.accession_no_dashes(raw).alias("plain"), C.accession_filer_cik(raw).alias("filer"))


_DECODED = "replace(replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&')"


@query(f"select page_id, sha256({_DECODED.format(c='html')}) as h, length({_DECODED.format(c='html')})::int as n from pages")
def decode_html(spark, sf_dir):
    text = C.decode_html(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", C.sha256_hex(F.col("t")).alias("h"), F.length("t").alias("n"))


_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_STRIPPED = f"trim(regexp_replace(replace({_DECODED.format(c=_BARE)}, '&amp;', '&'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


@query(f"select page_id, sha256({_STRIPPED}) as h from pages")
def strip_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.sha256_hex(C.strip_html(F.col("html"))).alias("h"))


_XML = "select o_orderkey, '<ns:doc><ns:Amount cur=\"x\"><value>' || o_totalprice || '</value></ns:Amount><item>a' || o_custkey || '</item><ITEM>b &amp; c</ITEM>' || case when o_orderkey % 3 = 0 then '<note> <b>n</b>  ' || o_orderstatus || '</note>' else '' end || '</ns:doc>' as x from {orders}"


@query(f"select o_orderkey, regexp_extract(x, '<value>(.*?)</value>', 1) as amount, case when o_orderkey % 3 = 0 then 'n ' || regexp_extract(x, '</b>  (.)</note>', 1) end as note from ({_XML})")
def xml_value(spark, sf_dir):
    return B.bind(spark, sf_dir, _XML).select("o_orderkey", C.xml_value(F.col("x"), "amount").alias("amount"), C.xml_value(F.col("x"), "note").alias("note"))


@query(f"select o_orderkey, 'a' || regexp_extract(x, '<item>a(.*?)</item>', 1) as first, 'b &amp; c' as second, 2 as n from ({_XML})")
def xml_blocks(spark, sf_dir):
    b = C.xml_blocks(F.col("x"), "item")
    return B.bind(spark, sf_dir, _XML).select("o_orderkey", F.get(b, F.lit(0)).alias("first"), F.get(b, F.lit(1)).alias("second"), F.size(b).alias("n"))


_NUMBERS = "select o_orderkey, case o_orderkey % 8 when 0 then null when 1 then '' when 2 then 'n/a' when 3 then '1-2' when 4 then '$1,' || lpad(cast(o_custkey as string), 3, '0') || '.50' when 5 then '-' || o_custkey when 6 then '(' || o_custkey || ')' else '1e' || o_custkey end as raw from {orders}"


@query(f"select o_orderkey, case when raw is null or raw = '' then null when d = '' then 0.0 else try_cast(d as double) end as x from (select *, regexp_replace(raw, '[^0-9.+-]', '', 'g') as d from ({_NUMBERS}))")
def as_number(spark, sf_dir):
    return B.bind(spark, sf_dir, _NUMBERS).select("o_orderkey", C.as_number(F.col("raw")).alias("x"))


_FLAGS = "select o_orderkey, case o_orderkey % 6 when 0 then null when 1 then ' TRUE ' when 2 then '1' when 3 then 'yes' when 4 then 'true' else ' 1' end as raw from {orders}"


@query(f"select o_orderkey, coalesce(lower(trim(raw)) in ('true', '1'), false) as b from ({_FLAGS})")
def as_boolean(spark, sf_dir):
    return B.bind(spark, sf_dir, _FLAGS).select("o_orderkey", C.as_boolean(F.col("raw")).alias("b"))


@query(f"select event_id, entity_id, role from ({B.PARTICIPANTS})")
def parse_participants(spark, sf_dir):
    text = G.packed(B.bind(spark, sf_dir, B.PARTICIPANTS), "event_id", F.concat_ws(":", "entity_id", "role"), "participants").withColumnRenamed("event_id", "id")
    return G.participants_of(text)


@query(f"""select id from ({B.EDGES}) where not coalesce(coalesce(valid_to, valid_from, substr(observed_at, 1, 10)) < '1996-06-01', false) and not coalesce(coalesce(valid_from, substr(observed_at, 1, 10)) > '1997-03-31', false)""")
def edge_in_date_range(spark, sf_dir):
    return G.filtered_edges(B.bind(spark, sf_dir, B.EDGES), date_from="1996-06-01", date_to="1997-03-31").select("id")


@query(f"""select src, count(*) as n, count(distinct dst) as others from (select subject_entity_id as src, object_entity_id as dst from ({B.EDGES}) union all select object_entity_id, subject_entity_id from ({B.EDGES}) where subject_entity_id <> object_entity_id) group by src""")
def adjacent(spark, sf_dir):
    return G.oriented(B.bind(spark, sf_dir, B.EDGES)).groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("others"))


_KEYED = f"""(select *, case when s1 is null and s2 is null then 0 else 1 end as has,
    coalesce(candidate_key, case when entity_type = 'PERSON' and s1 is null and s2 is null then source_agent || ':PERSON:unresolved:' || {sid('unresolved', "run_id || ':' || seq")}
        else source_agent || ':' || entity_type || ':' || coalesce(canonical_name, concat_ws('|', s1 || ':' || v1, s2 || ':' || v2)) end) as k from ({B.CANDIDATES}))"""


@query(f"select seq, k as key from {_KEYED}")
def candidate_key(spark, sf_dir):
    return R.with_keys(B.entity_candidates(spark, sf_dir)).select("seq", F.col("candidate_key").alias("key"))


_VOCABULARY = ", ".join(f"('{p}', '{c}', {'null' if i is None else repr(i)})" for p, c, i in VOCABULARY)


@query(f"select e.predicate, coalesce(category, 'CONTEXTUAL') as category, inverse, true as temporal, count(*) as n from (select predicate from ({B.EDGES}) union all select predicate from ({B.CAREERS}) union all select 'DONATED_TO' from {{region}}) e left join (values {_VOCABULARY}) v(predicate, category, inverse) using (predicate) group by all")
def classify(spark, sf_dir):
    rows = [B.bind(spark, sf_dir, t).select("predicate") for t in (B.EDGES, B.CAREERS)] + [read(spark, sf_dir, "region").select(F.lit("DONATED_TO").alias("predicate"))]
    counts = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("predicate").agg(F.count("*").alias("n"))
    return classify_predicates(counts)


# Validation ---------------------------------------------------------------------------------------------------------

_CHECKED = """
    select o_orderkey as seq, 'r' || (o_orderkey % 3) as run_id, case when o_orderkey % 13 = 0 then cast('NaN' as double) when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then 1.5 else 0.5 end as confidence, case when o_orderkey % 23 = 0 then '  ' else 'TABLE' end as extraction_method,
        case when o_orderkey % 29 = 0 then null else 'excerpt ' || o_custkey || case when o_orderkey % 12 = 1 then ' was Paid' else '' end end as excerpt, case when o_orderkey % 31 = 0 then 'HEARSAY' else 'DERIVED' end as evidence_class, case when o_orderkey % 37 = 0 then null else 'REPORTED' end as assertion_type,
        case when o_orderkey % 41 = 0 then '' else 'ORDERS' end as provider, case when o_orderkey % 43 = 0 then null else cast(o_custkey as string) end as external_id, case when o_orderkey % 47 = 0 then ' ' else 'word' end as w1, case when o_orderkey % 53 = 0 then null else 'text' || o_custkey end as w2,
        case when o_orderkey % 10 = 0 then cast(o_custkey as double) else 50.0 end as percentage, case when o_orderkey % 14 = 0 then -1.0 when o_orderkey % 15 = 0 then cast('NaN' as double) end as shares, 'C' || (o_custkey % 5) as a, 'C' || (o_orderkey % 5) as b, o_orderkey % 3 as parts from {orders}
"""
_BAD = "not coalesce(confidence >= 0 and confidence <= 1 and not isnan(confidence), false)"


def _rules(*rules: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when {c} then '{t}' end" for c, t in rules) + "], lambda x: x is not null)"


_EVIDENCE = (
    (_BAD, "confidence must be between 0 and 1"), ("trim(coalesce(extraction_method, '')) = ''", "extraction method is required"), ("trim(coalesce(excerpt, '')) = ''", "evidence excerpt is required"),
    ("evidence_class = 'HEARSAY'", "recognized evidence class is required"), ("assertion_type is null", "recognized assertion type is required"), ("coalesce(provider, '') = '' or coalesce(external_id, '') = ''", "source document reference is required"),
)


def _reasons(*rules: tuple[str, str]) -> str:
    return f"select seq, array_to_string({_rules(*rules)}, ';') as reasons from ({_CHECKED})"


def _checked(spark, sf_dir) -> DataFrame:
    null = F.lit(None).cast("string")
    ref = F.struct(null.alias("source_document_id"), F.col("provider"), F.col("external_id"), null.alias("sha256"))
    proof = F.struct(F.col("excerpt"), F.col("evidence_class"), F.lit(None).cast("map<string,string>").alias("fields"))
    return B.bind(spark, sf_dir, _CHECKED).withColumns({"source_document": ref, "evidence": proof, "candidate_key": null, "source_record_id": F.concat(F.lit("rec"), F.col("seq") % 700), "source_agent": F.col("w2")})


def _shown(checked: DataFrame) -> DataFrame:
    return checked.select("seq", F.array_join("reasons", ";").alias("reasons"))


@query(_reasons(*_EVIDENCE))
def validate_evidence(spark, sf_dir):
    return _shown(V.validate_evidence(_checked(spark, sf_dir)))


@query(_reasons(("trim(coalesce(provider, '')) = ''", "provider is required"), ("trim(w1) = ''", "document type is required"), ("trim(coalesce(external_id, '')) = ''", "external ID is required"), ("w2 is null", "source URL is required"), ("seq % 9 = 0", "SHA-256 must be a 64-character hex digest"), ("evidence_class = 'HEARSAY'", "recognized evidence class is required")))
def validate_sources(spark, sf_dir):
    sha = F.when(F.col("seq") % 9 == 0, "xyz").otherwise(C.sha256_hex(F.col("seq").cast("string")))
    return _shown(V.validate_sources(_checked(spark, sf_dir).withColumns({"document_type": F.col("w1"), "source_url": F.col("w2"), "sha256": sha})))


@query(f"""select seq, array_to_string(list_concat({_rules(("seq % 5 = 2", "recognized entity type is required"), ("w2 is null and seq % 3 = 0", "canonical name or authoritative identifier is required"), ("trim(w1) = ''", "source agent is required"), ("confidence is not null and " + _BAD, "confidence must be between 0 and 1"))},
    {_rules(("seq % 3 <> 0 and trim(w1) = ''", "identifier scheme and value are required"), ("seq % 3 = 2 and trim(w1) = ''", "identifier scheme and value are required"), ("seq % 3 = 2", "duplicate identifier in entity candidate"))},
    case when seq % 2 = 0 then {_rules(("excerpt is null", "entity evidence excerpt is required"), ("evidence_class = 'HEARSAY'", "recognized entity evidence class is required"), ("trim(extraction_method) = ''", "entity extraction method is required"), ("coalesce(provider, '') = '' or external_id is null", "entity source document reference is required"))} else [] end), ';') as reasons from ({_CHECKED})""")
def validate_entities(spark, sf_dir):
    one = F.struct(F.lit("LEI").alias("scheme"), F.col("w1").alias("value"), F.lit(None).cast("string").alias("jurisdiction"))
    ids = F.array_repeat(one, (F.col("seq") % 3).cast("int"))
    even = F.col("seq") % 2 == 0
    rows = _checked(spark, sf_dir).withColumns({"identifiers": ids, "canonical_name": F.col("w2"), "source_agent": F.col("w1"), "entity_type": F.when(F.col("seq") % 5 == 2, "THING").otherwise("FUND"), "evidence": F.when(even, F.col("evidence")), "extraction_method": F.when(even, F.col("extraction_method")), "assertion_type": F.when(even, F.col("assertion_type"))})
    return _shown(V.validate_entities(rows))


@query(_reasons(*_EVIDENCE, ("w2 is null", "source agent is required"), ("parts = 0", "resolvable entity reference is required"), ("trim(w1) = ''", "identifier scheme is required"), ("external_id is null", "identifier value is required")))
def validate_identifiers(spark, sf_dir):
    null = F.lit(None).cast("string")
    one = F.struct(F.lit("LEI").alias("scheme"), F.lit("x").alias("value"), null.alias("jurisdiction"))
    entity = F.struct(null.alias("entity_id"), F.lit("only a key").alias("candidate_key"), F.array_repeat(one, F.col("parts").cast("int")).alias("identifiers"))
    return _shown(V.validate_identifiers(_checked(spark, sf_dir).withColumns({"entity": entity, "identifier": F.struct(F.col("w1").alias("scheme"), F.col("external_id").alias("value"))})))


_RELATION = (*_EVIDENCE, ("trim(w1) = ''", "predicate is required"), ("w2 is null", "subject and object are required"), ("w2 is not null and a = b", "self-relationship is unsupported"), ("percentage < 0 or percentage > 100", "percentage must be between 0 and 100"), ("shares < 0", "shares cannot be negative"))


def _relations(spark, sf_dir) -> DataFrame:
    end = lambda c: F.struct(F.col(c).alias("entity_id"))
    return V.validate_relationships(_checked(spark, sf_dir).withColumns({"predicate": F.col("w1"), "subject": F.when(F.col("w2").isNotNull(), end("a")), "object": end("b")}))


@query(_reasons(*_RELATION))
def validate_relationships(spark, sf_dir):
    return _shown(_relations(spark, sf_dir))


@query(_reasons(*_EVIDENCE, ("trim(w1) = ''", "event type is required"), ("w2 is null", "description is required"), ("parts = 0", "at least one participant is required"), ("external_id is null", "source record ID is required")))
def validate_events(spark, sf_dir):
    rows = _checked(spark, sf_dir).withColumns({"event_type": F.col("w1"), "description": F.col("w2"), "participants": F.array_repeat(F.struct(F.col("a").alias("role")), F.col("parts").cast("int")), "source_record_id": F.col("external_id")})
    return _shown(V.validate_events(rows))


@query(_reasons(*_EVIDENCE, ("trim(w1) = ''", "claim type is required"), ("w2 is null", "statement is required")))
def validate_claims(spark, sf_dir):
    return _shown(V.validate_claims(_checked(spark, sf_dir).withColumns({"claim_type": F.col("w1"), "statement": F.col("w2")})))


@query(_reasons(("external_id is null", "missing source document"), ("excerpt is null", "missing supporting evidence"), ("w2 is null", "unresolved entity"), ("w2 is not null and a = b", "self-relationship is unsupported"), ("confidence > 1 and not isnan(confidence)", "confidence outside [0,1]"), ("percentage < 0 or percentage > 100", "percentage outside [0,100]"), ("shares < 0", "negative shares"), ("seq % 3 = 1 and excerpt like '%Paid%'", "holding is incorrectly described as a payment")))
def validate_resolved_relationships(spark, sf_dir):
    rows = _checked(spark, sf_dir).withColumns({"source_document_id": F.col("external_id"), "evidence": F.col("excerpt"), "subject_id": F.when(F.col("w2").isNotNull(), F.col("a")), "object_id": F.col("b"), "resolution_confidence": F.lit(1.0), "predicate": F.when(F.col("seq") % 3 == 1, "HOLDS_SECURITY").otherwise("OTHER")})
    return _shown(V.validate_resolved_relationships(rows))


_DATES = "case seq % 7 when 0 then '2024-02-30' when 1 then '2024-02-32' when 2 then '2024-13-01' when 3 then null when 4 then '2024-1-01' else '2024-12-31' end"


@query(_reasons(("external_id is null", "missing source document"), ("excerpt is null", "missing supporting evidence"), ("parts = 0", "event has no participants"), ("seq % 7 in (1, 2, 3, 4)", "invalid event date"), ("shares < 0", "negative shares"), ("confidence > 1 and not isnan(confidence)", "confidence outside [0,1]")))
def validate_resolved_events(spark, sf_dir):
    rows = _checked(spark, sf_dir).withColumns({"source_document_id": F.col("external_id"), "evidence": F.col("excerpt"), "n_participants": F.col("parts"), "event_date": F.expr(_DATES), "price_per_share": F.lit(None).cast("double")})
    return _shown(V.validate_resolved_events(rows))


@query(f"select run_id, count(*) as n, min(seq) as first from (select * exclude (seq), seq % 700 as record, min(seq) as seq from (select *, len({_rules(*_RELATION)}) as bad from ({_CHECKED})) where bad > 0 group by all) group by run_id")
def rejected_candidates(spark, sf_dir):
    return V.rejections(_relations(spark, sf_dir), "RELATIONSHIP").groupBy("run_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query(f"""select {sid('validation', "run_id || ':RELATIONSHIP:' || key || ':graph-core/1.0.0'")} as id, key as candidate_key, seq, bad = 0 as is_valid
    from (select *, row_number() over (partition by run_id, key order by seq desc) as r from (select *, 'rec' || (seq % 700) as key, len({_rules(*_RELATION)}) as bad from ({_CHECKED}))) where r = 1""")
def validation_log(spark, sf_dir):
    return V.validation_log(V.validation_results(_relations(spark, sf_dir), "RELATIONSHIP")).select("id", "candidate_key", "seq", "is_valid")


@query(f"select bad = 0 as valid, count(*) as n from (select len({_rules(*_RELATION)}) as bad from ({_CHECKED})) group by 1")
def split_valid(spark, sf_dir):
    good, bad = V.split_valid(_relations(spark, sf_dir))
    return good.select(F.lit(True).alias("valid")).unionByName(bad.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("n"))


# Resolution ---------------------------------------------------------------------------------------------------------

_SCHEMES = ", ".join(f"'{s}'" for s in AUTHORITATIVE_SCHEMES)
_NAMED = f"(select *, case when s1 in ({_SCHEMES}) then s1 when s2 in ({_SCHEMES}) then s2 end as ascheme, case when s1 in ({_SCHEMES}) then v1 when s2 in ({_SCHEMES}) then v2 end as avalue from {_KEYED} where canonical_name <> '')"
_KEPT = f"(select * from {_NAMED} qualify row_number() over (partition by run_id, k order by seq) = 1)"
_OWNED = f"(select scheme, value, min(seq) as holder from (select s1 as scheme, v1 as value, seq from {_KEPT} where s1 is not null union all select s2, v2, seq from {_KEPT} where s2 is not null) group by all)"
_FOREST = f"(select q.*, coalesce(holder, seq) as parent from {_KEPT} q left join {_OWNED} o on o.scheme = ascheme and o.value = avalue)"
_ROOTS = f"""with recursive forest as materialized (select * from {_FOREST}), up as (select seq, parent as here from forest union all select up.seq, f.parent from up join forest f on f.seq = up.here where f.parent <> f.seq),
    roots as (select seq, min(here) as root from up group by seq),
    ids as (select f.seq, f.run_id, f.k, f.seq <> f.parent as resolved, f.ascheme, coalesce({sid('entity', "t.ascheme || ':' || t.avalue")}, {sid('entity-unresolved', "t.run_id || ':' || t.k")}) as entity_id from roots join forest f using (seq) join forest t on t.seq = root)"""


def _named(spark, sf_dir) -> DataFrame:
    return B.entity_candidates(spark, sf_dir).filter("canonical_name <> ''")


@query(f"select seq, ascheme as scheme, avalue as value from {_NAMED}")
def first_authoritative(spark, sf_dir):
    first = S.first_authoritative(F.col("identifiers"))
    return _named(spark, sf_dir).select("seq", first["scheme"].alias("scheme"), first["value"].alias("value"))


@query(f"select seq, run_id, k as candidate_key from {_KEPT}")
def dedupe_within_run(spark, sf_dir):
    return R.dedupe_within_run(R.with_keys(_named(spark, sf_dir))).select("seq", "run_id", "candidate_key")


@query(f"{_ROOTS} select c.seq, entity_id, case when c.seq <> i.seq then 'REMEMBERED' when resolved then 'RESOLVED' else 'CREATED' end as status from {_NAMED} c join ids i on i.run_id = c.run_id and i.k = c.k")
def resolve_entities(spark, sf_dir):
    return R.resolve_entities(_named(spark, sf_dir)).select("seq", "entity_id", "status")


@query(f"{_ROOTS} select k as candidate_key, count(distinct entity_id) as entities, count(*) as records from ids where ascheme is null group by k")
def name_only_separation(spark, sf_dir):
    rows = R.resolve_entities(_named(spark, sf_dir)).filter("kept and scheme is null")
    return rows.groupBy("candidate_key").agg(F.count_distinct("entity_id").alias("entities"), F.count("*").alias("records"))


#: Who is accepted depends on who was: so many rounds of the rule, of which the last few change nothing.
_ROUNDS = 8
_ACCEPTED = f"""with recursive every as materialized (select *, case when s1 in ({_SCHEMES}) then s1 when s2 in ({_SCHEMES}) then s2 end as ascheme, case when s1 in ({_SCHEMES}) then v1 when s2 in ({_SCHEMES}) then v2 end as avalue from {_KEYED}),
    s0 as (select * from every where canonical_name <> ''), """ + "".join(f"""
    kept{n} as materialized (select * from s{n} qualify row_number() over (partition by run_id, k order by seq) = 1),
    own{n} as materialized (select scheme, value, min(seq) as holder from (select s1 as scheme, v1 as value, seq from kept{n} where s1 is not null union all select s2, v2, seq from kept{n} where s2 is not null) group by all),
    s{n + 1} as (select * from s0 union all select e.* from every e join own{n} on scheme = ascheme and value = avalue and holder < seq where canonical_name is null),""" for n in range(_ROUNDS))
_UNNAMED = f"""{_ACCEPTED}
    kept as materialized (select * from s{_ROUNDS} qualify row_number() over (partition by run_id, k order by seq) = 1),
    own as (select scheme, value, min(seq) as holder from (select s1 as scheme, v1 as value, seq from kept where s1 is not null union all select s2, v2, seq from kept where s2 is not null) group by all),
    forest as materialized (select q.*, coalesce(least(holder, seq), seq) as parent from kept q left join own o on o.scheme = ascheme and o.value = avalue),
    up as (select seq, parent as here from forest union all select up.seq, f.parent from up join forest f on f.seq = up.here where f.parent <> f.seq),
    roots as (select seq, min(here) as root from up group by seq),
    ids as (select f.seq as first, f.run_id, f.k, f.seq <> f.parent as resolved, coalesce({sid('entity', "t.ascheme || ':' || t.avalue")}, {sid('entity-unresolved', "t.run_id || ':' || t.k")}) as entity_id from roots join forest f using (seq) join forest t on t.seq = root)
    select seq, e.k as candidate_key, coalesce(first = seq, false) as kept, case when first <= seq then entity_id end as entity_id,
        case when first = seq and resolved then 'RESOLVED' when first = seq then 'CREATED' when first <= seq then 'REMEMBERED' else 'REJECTED' end as status
    from every e left join ids i on i.run_id = e.run_id and i.k = e.k"""


@query(_UNNAMED)
def resolve_unnamed_entities(spark, sf_dir):
    return R.resolve_entities(B.entity_candidates(spark, sf_dir)).select("seq", "candidate_key", "kept", "entity_id", "status")


@query(f"""{_ROOTS} select k as candidate_key, entity_id as proposed_entity_id, case when resolved then 'RESOLVED' else 'CREATED' end as status, confidence,
    case when resolved then 'matched authoritative identifier ' || i.ascheme when i.ascheme is not null then 'created from authoritative identifier ' || i.ascheme else 'created as a distinct unresolved identity; name-only merging is disabled' end as reason from ids i join (select seq, confidence from ({B.CANDIDATES})) using (seq)""")
def resolution_log(spark, sf_dir):
    rows = _named(spark, sf_dir)
    log = R.resolution_log(rows, R.resolve_entities(rows))
    return log.select("candidate_key", "proposed_entity_id", "status", "confidence", F.get("reasons", F.lit(0)).alias("reason"))


_REFS = "select o_orderkey as ref_id, 'r' || (o_orderkey % 3) as run_id, o_orderkey as seq, 'agent' as source_agent, case when o_orderkey % 4 = 0 then 'C' || o_custkey when o_orderkey % 4 = 1 then 'gone' end as entity_id, case when o_orderkey % 4 = 2 then 'k' || o_custkey end as candidate_key, case when o_orderkey % 4 <> 3 then 'INTERNAL' end as scheme, 'c' || (o_custkey + o_orderkey % 7 * 1000000 * (o_orderkey % 2)) as value, case when o_orderkey % 5 = 0 then 'Stub ' || o_custkey || '-' || (o_orderkey % 7) || '-' || (o_orderkey % 4) end as name from {orders}"


@query(f"""with r as (select *, coalesce(candidate_key, 'agent:COMPANY:' || name) as k, coalesce(case when entity_id like 'C%' then entity_id end, case when candidate_key is not null and run_id = 'r0' then 'C' || substr(candidate_key, 2) end, case when scheme is not null and cast(substr(value, 2) as bigint) < 1000000 then 'C' || substr(value, 2) end) as found from ({_REFS})),
    s as (select *, first_value(case when scheme is not null then {sid('entity', "scheme || ':' || value")} else {sid('entity-unresolved', "run_id || ':' || k")} end) over (partition by run_id, k order by ref_id) as stub from r where found is null and name is not null),
    m as (select value, min(ref_id) as since from r where found is null and name is not null and scheme is not null group by value)
    select r.ref_id, coalesce(r.found, case when r.scheme is not null and since <= r.ref_id then {sid('entity', "r.scheme || ':' || r.value")} end, s.stub) as entity_id
    from r left join s using (ref_id) left join m on m.value = r.value""")
def resolve_entity_refs(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    ids = F.when(F.col("scheme").isNotNull(), F.array(F.struct("scheme", "value", F.lit(None).cast("string").alias("jurisdiction")))).otherwise(F.array().cast(f"array<{B.ID}>"))
    ref = F.struct("entity_id", "candidate_key", ids.alias("identifiers"), F.col("name").alias("canonical_name"), F.lit("COMPANY").alias("entity_type"))
    refs = B.bind(spark, sf_dir, _REFS).select("ref_id", "run_id", "seq", "source_agent", ref.alias("ref"))
    own = F.concat(F.lit("C"), "c_custkey")
    found, _ = L.resolve_entity_refs(refs, customers.select(own.alias("entity_id")), customers.select(F.lit("r0").alias("run_id"), F.concat(F.lit("k"), "c_custkey").alias("candidate_key"), own.alias("entity_id")), customers.select(F.lit("INTERNAL").alias("scheme"), F.concat(F.lit("c"), "c_custkey").alias("value"), own.alias("entity_id")))
    return found.select("ref_id", "entity_id")


_VERSIONS = "select 'v' || o_orderkey as id, 'P' || (o_custkey % 3) as provider, cast(o_custkey as string) as external_id, 'sha' || (o_orderkey % 5) as sha256, cast(o_orderdate as string) as retrieved_at from {orders}"
_ASKED = "select o_orderkey as ref_id, case when o_orderkey % 3 = 0 then 'v' || (o_orderkey * 2) end as source_document_id, 'P' || (o_custkey % 3) as provider, cast(o_custkey as string) as external_id, case when o_orderkey % 3 = 1 then 'sha' || (o_orderkey % 7) end as sha256 from {orders}"


@query(f"""with s as ({_VERSIONS}), q as ({_ASKED}) select ref_id, case when q.source_document_id is not null then (select id from s where s.id = q.source_document_id) when q.sha256 is not null then e.id else l.id end as source_id from q
    left join (select provider, external_id, sha256, arg_max(id, (retrieved_at, id)) as id from s group by all) e using (provider, external_id, sha256) left join (select provider, external_id, arg_max(id, (retrieved_at, id)) as id from s group by all) l on l.provider = q.provider and l.external_id = q.external_id""")
def resolve_source_refs(spark, sf_dir):
    asked = B.bind(spark, sf_dir, _ASKED).select("ref_id", F.struct("source_document_id", "provider", "external_id", "sha256").alias("source_document"))
    return L.known_sources(asked, B.bind(spark, sf_dir, _VERSIONS)).select("ref_id", "source_id")


_ATTACH = "select o_orderkey as seq, o_orderkey % 9 <> 0 as valid, case when o_orderkey % 8 <> 0 then 'C' || (o_custkey % 400) end as entity_id, case when o_orderkey % 10 <> 0 then 'O1' end as source_id, 'LEI' as scheme, 'L' || (o_orderkey % 2000) as value from {orders}"
_KNOWN = "select 'LEI' as scheme, 'L' || c_custkey as value, 'C' || (c_custkey % 400) as entity_id from {customer} where c_custkey % 4 = 0"


@query(f"""with c as ({_ATTACH}), o as (select scheme, value, arg_min(entity_id, seq) as owner, min(seq) as since from (select scheme, value, entity_id, seq from c where valid and entity_id is not null and source_id is not null union all select scheme, value, entity_id, -1 from ({_KNOWN})) group by all)
    select seq, owner, case when not valid or entity_id is null or source_id is null then 'REJECTED' when owner <> entity_id then 'REVIEW_REQUIRED' when since < seq then 'EXISTING' else 'ATTACHED' end as status from c left join o using (scheme, value)""")
def attach_identifiers(spark, sf_dir):
    return R.attach_identifiers(B.bind(spark, sf_dir, _ATTACH), B.bind(spark, sf_dir, _KNOWN)).select("seq", "owner", "status")


_DECIDED = "select o_orderkey as seq, o_orderkey % 9 <> 0 as valid, 'C' || (o_custkey * (1 + o_orderkey % 2)) as existing_entity_id, o_orderkey % 3 = 0 as names_source, case when o_orderkey % 6 = 0 then 'O1' end as source_id, 'LEI' as scheme, 'L' || (o_orderkey % 2000) as value from {orders}"


def _decided(spark, sf_dir):
    rows = B.bind(spark, sf_dir, _DECIDED).withColumn("identifiers", F.array(F.struct("scheme", "value"))).drop("scheme", "value")
    return R.apply_resolution_decisions(rows, read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("entity_id")), B.bind(spark, sf_dir, _KNOWN))


@query(f"""select seq, case when not valid then 'candidate is invalid' when c_custkey is null then 'resolution target not found' when names_source and source_id is null then 'resolution source document could not be resolved' when k.entity_id <> existing_entity_id then 'LEI:' || d.value || ' belongs to another entity' end as reason
    from ({_DECIDED}) d left join {{customer}} on existing_entity_id = 'C' || c_custkey left join ({_KNOWN}) k on k.value = d.value""")
def apply_resolution_decisions(spark, sf_dir):
    good, bad = _decided(spark, sf_dir)
    return good.select("seq", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("seq", F.col("quarantine_reason").alias("reason")))


_CASES = "select o_orderkey as seq, 'SEC' as source_provider, 'src' || o_orderkey as source_identifier, 'k' || (o_custkey % 300) as candidate_key, 'C' || (o_custkey % 50) as existing_entity_id, case o_orderkey % 4 when 0 then 'APPROVED' when 1 then 'REVIEW_REQUIRED' when 2 then 'NO_MATCH' else 'AUTO_RESOLVED' end as status, o_totalprice as score, 'reason ' || (o_orderkey % 3) as reason from {orders}"
_CASE_ID = sid("resolution-case", "source_provider || ':' || candidate_key || ':' || existing_entity_id")


@query(f"select {_CASE_ID} as id, arg_max(status, seq) as status, arg_max(score, seq) as score, min(seq) as created_seq, max(seq) as updated_seq, arg_min(source_identifier, seq) as source_identifier from ({_CASES}) group by source_provider, candidate_key, existing_entity_id")
def resolution_cases(spark, sf_dir):
    return R.resolution_cases(B.bind(spark, sf_dir, _CASES)).select("id", "status", "score", "created_seq", "updated_seq", "source_identifier")


@query(f"select {_CASE_ID} as id, case when max(seq) % 2 = 0 then 'APPROVED' else 'REVIEW_REQUIRED' end as status, max(seq) as updated_seq from ({_CASES}) group by source_provider, candidate_key, existing_entity_id having arg_max(status, seq) = 'REVIEW_REQUIRED'")
def review_queue(spark, sf_dir):
    cases = R.list_cases(R.resolution_cases(B.bind(spark, sf_dir, _CASES)), "REVIEW_REQUIRED")
    done = cases.filter("updated_seq % 2 = 0").select("id", F.lit("APPROVED").alias("status"))
    return R.set_case_status(cases, done).select("id", "status", "updated_seq")


_UNRESOLVED = f"select {_CASE_ID} as id, arg_max(status, seq) as status, max(seq) as updated_seq from ({_CASES}) where status in ('REVIEW_REQUIRED', 'NO_MATCH') group by source_provider, candidate_key, existing_entity_id"


def _decisions(spark, sf_dir) -> DataFrame:
    """The cases' records as decisions on entity candidates; run and agent follow from the order's number."""
    none = F.array().cast(f"array<{B.ID}>")
    return B.bind(spark, sf_dir, _CASES).withColumns({
        "run_id": F.concat(F.lit("r"), F.col("seq") % 3), "source_agent": F.lit("agent"), "entity_type": F.lit("COMPANY"), "identifiers": none, "decision_actor": F.lit("reviewer"),
        "candidate_key": F.when(F.col("seq") % 5 != 0, F.col("candidate_key"))})


#: A decision without a key gets agent:type:identifiers.
_DECISIONS = f"(select * replace (case when seq % 5 <> 0 then candidate_key else 'agent:COMPANY:' end as candidate_key), 'r' || (seq % 3) as run_id from ({_CASES}))"
_LOG_ID = sid("resolution", "run_id || ':' || candidate_key || ':' || existing_entity_id || ':' || status")


@query(f"""select 'case' as kind, {_CASE_ID} as id, arg_max(status, seq) as status, max(seq) as seq from {_DECISIONS} where status in ('REVIEW_REQUIRED', 'NO_MATCH')
        group by source_provider, candidate_key, existing_entity_id
    union all select 'log', {_LOG_ID}, status, max(seq) from {_DECISIONS} where status in ('REVIEW_REQUIRED', 'NO_MATCH') group by run_id, candidate_key, existing_entity_id, status""")
def record_unresolved(spark, sf_dir):
    cases, log = R.record_unresolved(_decisions(spark, sf_dir))
    return cases.select(F.lit("case").alias("kind"), "id", "status", F.col("updated_seq").alias("seq")).unionByName(log.select(F.lit("log").alias("kind"), "id", "status", "seq"))


_DECISION_ID = sid("resolution-decision", f"{_CASE_ID} || ':' || status || ':reviewer:' || reason")


@query(f"""select 'case' as kind, {_CASE_ID} as id, max(seq) as seq from {_DECISIONS} where status in ('APPROVED', 'AUTO_RESOLVED') group by source_provider, candidate_key, existing_entity_id
    union all select 'decision', {_DECISION_ID}, min(seq) from {_DECISIONS} where status in ('APPROVED', 'AUTO_RESOLVED') group by source_provider, candidate_key, existing_entity_id, status, reason
    union all select 'log', {_LOG_ID}, max(seq) from {_DECISIONS} where status in ('APPROVED', 'AUTO_RESOLVED') group by run_id, candidate_key, existing_entity_id, status
    union all select distinct 'key', run_id || ':' || candidate_key || ':' || existing_entity_id, 0 from {_DECISIONS} where status in ('APPROVED', 'AUTO_RESOLVED')""")
def resolution_records(spark, sf_dir):
    made = R.resolution_records(_decisions(spark, sf_dir).filter(F.col("status").isin("APPROVED", "AUTO_RESOLVED")))
    keys = made["run_keys"].select(F.lit("key").alias("kind"), F.concat_ws(":", "run_id", "candidate_key", "entity_id").alias("id"), F.lit(0).cast("long").alias("seq"))
    rows = [made[name].select(F.lit(kind).alias("kind"), "id", F.col(seq).alias("seq")) for name, kind, seq in (("cases", "case", "updated_seq"), ("decisions", "decision", "seq"), ("resolutions", "log", "seq"))]
    return I.union([*rows, keys])


@query(f"select case_id, status as decision_type, reason, min(seq) as seq from (select *, {_CASE_ID} as case_id from ({_CASES})) group by all")
def resolution_decisions(spark, sf_dir):
    rows = B.bind(spark, sf_dir, _CASES).withColumns({"case_id": R.case_id(F.col("source_provider"), F.col("candidate_key"), F.col("existing_entity_id")), "decision_type": F.col("status"), "decision_actor": F.lit("reviewer")})
    return R.resolution_decisions(rows).select("case_id", "decision_type", "reason", "seq")


_PEOPLE = "select 'C' || c_custkey as id, 'PERSON' as entity_type, substr('ABCDEFGHIJ', cast(1 + c_custkey % 10 as int), 1) || 'x Mid Last' || (c_custkey % 40) as canonical_name, c_nationkey from {customer}"
_MENTIONS = "select c_custkey as mention_id, case when c_custkey % 3 = 0 then 'LAST' || (c_custkey % 40) else substr('abcdefghij', cast(1 + c_custkey % 10 as int), 1) || '. Last' || (c_custkey % 40) end as name, 'N' || c_nationkey as issuer_id from {customer}"


@query(f"""select mention_id, min(p.id) as person_id from ({_MENTIONS}) m join ({_PEOPLE}) p on issuer_id = 'N' || p.c_nationkey
    and (lower(p.canonical_name) = lower(m.name) or (m.name like '% %' and lower(substr(p.canonical_name, 1, 1)) = substr(m.name, 1, 1) and lower(string_split(p.canonical_name, ' ')[-1]) = lower(string_split(m.name, ' ')[-1]))) group by mention_id having count(distinct p.id) = 1""")
def resolve_person_for_issuer(spark, sf_dir):
    people = B.bind(spark, sf_dir, _PEOPLE)
    edges = people.select(F.col("id").alias("subject_entity_id"), F.concat(F.lit("N"), "c_nationkey").alias("object_entity_id"), F.lit("OFFICER_OF").alias("predicate"))
    return R.resolve_person_for_issuer(B.bind(spark, sf_dir, _MENTIONS), people, edges, ("OFFICER_OF", "DIRECTOR_OF"))


# Survivorship -------------------------------------------------------------------------------------------------------

_OWN = f"(select 'e' || o_custkey as entity_id, c.* from ({B.CANDIDATES}) c join {{orders}} on o_orderkey = seq)"


def _owned(spark, sf_dir) -> DataFrame:
    return B.entity_candidates(spark, sf_dir).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("e"), "o_custkey").alias("entity_id")), "seq")


_SOURCES = "select o_orderkey as seq, 'P' || (o_orderkey % 2) as provider, cast(o_custkey as string) as external_id, 'sha' as sha256, 'T' || o_orderkey as title from {orders}"


@query(f"select {sid('source', "provider || ':' || external_id || ':' || sha256")} as id, arg_min(title, seq) as title, 'FIRST_PARTY' as evidence_class from ({_SOURCES}) group by provider, external_id, sha256")
def save_sources(spark, sf_dir):
    rows = B.bind(spark, sf_dir, _SOURCES).withColumns({"retrieved_at": F.lit(None).cast("string"), "evidence_class": F.lit(None).cast("string")})
    return S.save_sources(rows, "2024-01-01T00:00:00Z").select("id", "title", "evidence_class")




@query(f"""select entity_id, regexp_replace(arg_max(canonical_name, seq) filter (canonical_name is not null), ' +', ' ', 'g') as canonical_name, case when arg_min(entity_type, seq) = 'ORGANIZATION' and bool_or(entity_type = 'COMPANY') then 'COMPANY' else arg_min(entity_type, seq) end as entity_type,
    arg_max(jurisdiction, seq) filter (jurisdiction is not null) as jurisdiction, 'ACTIVE' as status, arg_min(confidence, seq) as resolution_confidence, max(seq)::varchar as last_tag from {_OWN} group by entity_id""")
def merge_entities(spark, sf_dir):
    return S.merge_entities(_owned(spark, sf_dir)).select("entity_id", "canonical_name", "entity_type", "jurisdiction", "status", "resolution_confidence", F.try_element_at("attributes", F.lit("last")).alias("last_tag"))


@query(f"""select entity_id, k, (max({{{{'s': seq, 'v': v}}}})).v as v from (select entity_id, seq, 'last' as k, seq::varchar as v from {_OWN} union all select entity_id, seq, 'm' || (seq % 3), case when seq % 4 <> 0 then source_agent end from {_OWN}) group by all""".replace("{{", "{").replace("}}", "}"))
def merge_attributes(spark, sf_dir):
    return S.merge_attributes(_owned(spark, sf_dir), "entity_id").select("entity_id", F.explode("attributes").alias("k", "v"))


@query(f"""with a as (select *, seq % 2 = 0 as base from {_OWN}), e as (select entity_id, arg_min(canonical_name, seq) as name, arg_min(entity_type, seq) as t, arg_min(jurisdiction, seq) as j, arg_min(confidence, seq) as c from (select * replace(coalesce(canonical_name, chr(0)) as canonical_name, coalesce(jurisdiction, chr(0)) as jurisdiction) from a) where base group by all),
    r as (select a.* from a join e using (entity_id) where not base)
    select e.entity_id, nullif(any_value(name), chr(0)) as canonical_name, case when any_value(t) = 'ORGANIZATION' and bool_or(r.entity_type = 'COMPANY') then 'COMPANY' else any_value(t) end as entity_type, coalesce(nullif(any_value(j), chr(0)), arg_min(r.jurisdiction, r.seq) filter (r.jurisdiction is not null)) as jurisdiction, greatest(any_value(c), max(r.confidence)) as resolution_confidence
    from e left join r using (entity_id) group by e.entity_id""")
def enrich_entities(spark, sf_dir):
    rows = _owned(spark, sf_dir)
    base = S.first_wins(rows.filter("seq % 2 = 0"), "entity_id").withColumn("resolution_confidence", F.col("confidence"))
    return S.enrich_entities(base, rows.filter("seq % 2 = 1")).select("entity_id", "canonical_name", "entity_type", "jurisdiction", "resolution_confidence")


_EACH_ID = f"(select entity_id, seq, 0 as pos, s1 as scheme, v1 as value from {_OWN} where s1 is not null union all select entity_id, seq, case when s1 is null then 0 else 1 end, s2, v2 from {_OWN} where s2 is not null)"


@query(f"select {sid('identifier', "scheme || ':' || value || ':'")} as id, scheme, value, arg_min(entity_id, (seq, pos)) as entity_id from {_EACH_ID} group by scheme, value")
def save_identifiers(spark, sf_dir):
    return S.save_identifiers(_owned(spark, sf_dir)).select("id", "scheme", "value", "entity_id")


@query(f"select {sid('alias', "entity_id || ':' || lower(alias)")} as id, entity_id, arg_min(alias, seq) as alias from (select entity_id, seq, case when seq % 2 = 0 then upper(alias) else alias end as alias from {_OWN} where alias is not null) group by entity_id, lower(alias)")
def save_aliases(spark, sf_dir):
    rows = _owned(spark, sf_dir).withColumn("aliases", F.transform("aliases", lambda a: F.when(F.col("seq") % 2 == 0, F.upper(a)).otherwise(a)))
    return S.save_aliases(rows).select("id", "entity_id", "alias")


@query(f"with i as (select scheme, value, arg_min(entity_id, (seq, pos)) as entity_id from {_EACH_ID} group by scheme, value) select e.entity_id, coalesce(ids, '') as ids, n from (select entity_id, count(*) as n from {_OWN} group by all) e left join (select entity_id, string_agg(scheme || ':' || value, '|' order by scheme || ':' || value) as ids from i group by all) using (entity_id)")
def entity_identity(spark, sf_dir):
    rows = _owned(spark, sf_dir)
    full = R.entity_identity(rows.groupBy("entity_id").agg(F.count("*").alias("n")), S.save_identifiers(rows), S.save_aliases(rows))
    return full.select("entity_id", F.coalesce(F.array_join(F.transform("identifiers", lambda i: F.concat_ws(":", i["scheme"], i["value"])), "|"), F.lit("")).alias("ids"), "n")


# Ingestion ----------------------------------------------------------------------------------------------------------

def _context(spark, sf_dir):
    """Customers, suppliers and parts as entities known by an INTERNAL identifier, and orders as sources."""
    nodes = B.bind(spark, sf_dir, B.NODES)
    owners = nodes.select(F.lit("INTERNAL").alias("scheme"), F.col("id").alias("value"), F.col("id").alias("entity_id"))
    sources = B.bind(spark, sf_dir, B.SOURCES).withColumns({"external_id": F.col("accession_number"), "sha256": F.lit("x"), "retrieved_at": F.col("filed_at"), "source_url": F.lit("u"), "published_at": F.lit(None).cast("string")})
    return sources, owners.select("entity_id"), owners.select(F.lit("r").alias("run_id"), F.col("value").alias("candidate_key"), "entity_id").limit(0), owners


def _ref(value):
    null = F.lit(None).cast("string")
    return F.struct(null.alias("entity_id"), null.alias("candidate_key"), F.array(F.struct(F.lit("INTERNAL").alias("scheme"), value.alias("value"), null.alias("jurisdiction"))).alias("identifiers"), null.alias("canonical_name"), null.alias("entity_type"))


_HELD = "select l_orderkey * 10000000000 + l_partkey * 10000 + l_suppkey % 1000 * 10 + l_linenumber as seq, l_orderkey, case when l_linenumber = 7 then 'C-none' else 'C' || o_custkey end as c, 'P' || l_partkey as p, cast(cast(o_orderdate as date) as string) as d, case when l_linenumber = 2 then '' else 'line of order ' || l_orderkey end as excerpt, l_linenumber, l_suppkey from {lineitem} join {orders} on l_orderkey = o_orderkey"


def _proof(df: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    source = F.struct(null.alias("source_document_id"), F.when(F.col("l_orderkey") % 50 == 0, "TEST_FIXTURE").otherwise("SEC").alias("provider"), F.concat(F.lit("acc"), "l_orderkey").alias("external_id"), null.alias("sha256"))
    proof = F.struct(F.col("excerpt"), F.lit("OFFICIAL_RECORD").alias("evidence_class"), F.lit(None).cast("map<string,string>").alias("fields"))
    return df.withColumns({"run_id": F.lit("r"), "source_agent": F.lit("orders"), "candidate_key": null, "confidence": F.lit(0.9), "extraction_method": F.lit("TABLE"), "assertion_type": F.lit("REPORTED"), "source_document": source, "evidence": proof, "attributes": F.lit(None).cast("map<string,string>"), "currency": F.lit("USD"), "amount": F.lit(None).cast("double"), "shares": F.lit(None).cast("double"), "percentage": F.lit(None).cast("double"), "valid_to": null, "observed_at": null, "source_record_id": F.concat_ws(":", "p", F.col("l_suppkey").cast("string"))})


def _holdings(spark, sf_dir):
    rows = _proof(stage(B.bind(spark, sf_dir, _HELD), "held")).withColumns({"subject": _ref(F.col("c")), "object": _ref(F.col("p")), "predicate": F.lit("HOLDS_SECURITY"), "valid_from": F.col("d"), "resolution_confidence": F.lit(None).cast("double")}).drop("c", "p", "d", "excerpt", "l_linenumber", "l_suppkey", "l_orderkey")
    return I.ingest_relationships(rows, *_context(spark, sf_dir), as_of="2024-01-01T00:00:00Z")


_HELD_ID = sid("relationship", "c || ':HOLDS_SECURITY:' || p || ':O' || l_orderkey || ':' || d || ':' || p || ':' || l_suppkey")


@query(f"select {_HELD_ID} as id, c as subject_entity_id, p as object_entity_id, 'O' || l_orderkey as source_document_id, min(seq) as seq from ({_HELD}) where l_linenumber not in (2, 7) group by all")
def ingest_relationships(spark, sf_dir):
    return _holdings(spark, sf_dir)["relationships"].select("id", "subject_entity_id", "object_entity_id", "source_document_id", "seq")


@query(f"select 'invalid' as kind, count(*) as n from ({_HELD}) where l_linenumber = 2 union all select 'unresolved', count(*) from ({_HELD}) where l_linenumber = 7 union all select 'stored', count(distinct {_HELD_ID}) from ({_HELD}) where l_linenumber not in (2, 7)")
def ingestion_outcomes(spark, sf_dir):
    found = _holdings(spark, sf_dir)
    total = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return total(found["checked"].filter("not valid"), "invalid").unionByName(total(found["unresolved"], "unresolved")).unionByName(total(found["relationships"], "stored"))


@query(f"""select {sid('evidence', "'RELATIONSHIP:' || id || ':O' || l_orderkey || ':' || excerpt")} as id, id as subject_id, min(seq) as seq from (select *, {_HELD_ID} as id from ({_HELD}) where l_linenumber not in (2, 7)) group by id, l_orderkey, excerpt""")
def collect_evidence(spark, sf_dir):
    return I.collect_evidence(I.evidence_rows(_holdings(spark, sf_dir)["all"], "RELATIONSHIP")).select("id", "subject_id", "seq")


def _order_events(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("C"), "o_custkey").alias("c"), "o_orderstatus")
    sellers = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("S"), "l_suppkey")).alias("s"))
    rows = orders.join(sellers, "l_orderkey", "left").withColumns({"s": F.coalesce("s", F.array().cast("array<string>")), "excerpt": F.lit("order"), "p": F.lit("order"), "l_suppkey": F.col("l_orderkey"), "seq": F.col("l_orderkey")})
    people = F.concat(F.array(F.struct(_ref(F.col("c")).alias("entity"), F.lit("BUYER").alias("role"))), F.transform("s", lambda x: F.struct(_ref(x).alias("entity"), F.lit("SELLER").alias("role"))))
    rows = _proof(rows).withColumns({"participants": people, "event_type": F.col("o_orderstatus"), "event_date": F.lit(None).cast("string"), "description": F.lit("an order"), "price_per_share": F.lit(None).cast("double")})
    return I.ingest_events(rows.drop("c", "s", "p", "excerpt", "l_suppkey", "l_orderkey", "o_orderstatus"), *_context(spark, sf_dir), as_of="2024-01-01T00:00:00Z")


_EVENT_ID = sid("event", "'O' || o_orderkey || ':order:' || o_orderkey")


@query(f"select {_EVENT_ID} as id, o_orderstatus as event_type, cast(cast(o_orderdate as date) as varchar) as event_date from {{orders}}")
def ingest_events(spark, sf_dir):
    return _order_events(spark, sf_dir)["events"].select("id", "event_type", "event_date")


@query(f"select {_EVENT_ID} as event_id, entity_id, role from ({B.PARTICIPANTS}) join {{orders}} on event_id = 'E' || o_orderkey")
def event_participants(spark, sf_dir):
    return _order_events(spark, sf_dir)["participants"]


def _order_claims(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("C"), "o_custkey").alias("c"), F.concat(F.lit("status "), "o_orderstatus").alias("statement"), F.floor("o_totalprice").alias("total"))
    rows = rows.withColumns({"l_orderkey": F.col("l_orderkey") % 100, "excerpt": F.col("statement"), "p": F.lit("claim"), "l_suppkey": F.col("l_orderkey") % 700})
    fact = F.to_json(F.struct(F.lit("t").alias("taxonomy"), F.lit("Total").alias("concept"), F.lit("USD").alias("unit"), F.col("total").cast("double").alias("value"), F.lit("2024-12-31").alias("period_end")))
    known = F.col("seq") % 6 != 0
    rows = _proof(rows).withColumns({"subject": F.when(known, _ref(F.col("c"))), "claim_type": F.when(F.col("seq") % 2 == 0, "FINANCIAL_FACT").otherwise("REPORT"), "attributes": F.create_map(F.lit("fact"), fact), "valid_from": F.lit(None).cast("string")})
    return I.ingest_claims(rows.drop("c", "p", "excerpt", "l_suppkey", "l_orderkey", "total"), *_context(spark, sf_dir), as_of="2024-01-01T00:00:00Z")


_CLAIMS = "(select o_orderkey as seq, case when o_orderkey % 6 <> 0 then 'C' || o_custkey end as subject, case when o_orderkey % 2 = 0 then 'FINANCIAL_FACT' else 'REPORT' end as claim_type, 'O' || (o_orderkey % 100) as source, 'claim:' || (o_orderkey % 700) as record, 'status ' || o_orderstatus as statement, cast(floor(o_totalprice) as bigint) as total from {orders})"
_CLAIM_ID = sid("claim", "coalesce(subject, '') || ':' || claim_type || ':' || source || ':' || record")


@query(f"select {_CLAIM_ID} as id, subject as subject_entity_id, arg_max(statement, seq) as statement, min(seq) as seq, {sid('evidence', f"'CLAIM:' || {_CLAIM_ID} || ':' || source || ':' || arg_max(statement, seq)")} as evidence_assertion_id from {_CLAIMS} group by subject, claim_type, source, record")
def ingest_claims(spark, sf_dir):
    return _order_claims(spark, sf_dir)["claims"].select("id", "subject_entity_id", "statement", "seq", "evidence_assertion_id")


@query(f"select {sid('fact', "subject || ':t:Total:USD:2024-12-31:' || cast(total_d as varchar) || ':' || source")} as id, subject as entity_id, total_d as value, min(seq) as seq from (select *, total::double as total_d from {_CLAIMS}) where claim_type = 'FINANCIAL_FACT' and subject is not null group by subject, total_d, source")
def facts_from_claims(spark, sf_dir):
    return I.facts_from_claims(_order_claims(spark, sf_dir)["all"]).select("id", "entity_id", "value", "seq")


# A whole batch of all kinds: customers as entities, orders as sources, relationships, events and claims, suppliers'
# tickers as identifiers. Every fiftieth source has no digest, every seventh customer no name.

def _batch(spark, sf_dir) -> dict[str, DataFrame]:
    null, no_map = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    ids = lambda scheme, value: F.array(F.struct(F.lit(scheme).alias("scheme"), value.alias("value"), *[null.alias(c) for c in ("jurisdiction", "source_document_id", "valid_from", "valid_to")], no_map.alias("attributes")))
    end = lambda ids=None, kind=None, name=None: F.struct(
        null.alias("entity_id"), null.alias("candidate_key"), (F.lit(None).cast(f"array<{_IDENTIFIER}>") if ids is None else ids).alias("identifiers"), (null if name is None else name).alias("canonical_name"),
        (null if kind is None else F.lit(kind)).alias("entity_type"))
    said = lambda order: {
        "source_document": F.struct(null.alias("source_document_id"), F.lit("SEC").alias("provider"), F.concat(F.lit("acc"), order).alias("external_id"), null.alias("sha256")),
        "evidence": F.struct(F.concat(F.lit("order "), order).alias("excerpt"), F.lit("OFFICIAL_RECORD").alias("evidence_class"), no_map.alias("fields")), "extraction_method": F.lit("TABLE"),
        "assertion_type": F.lit("REPORTED"), "confidence": F.lit(1.0), "source_record_id": F.concat(F.lit("rec"), order)}
    head = lambda seq: {"seq": seq, "run_id": F.concat(F.lit("r"), seq % 3), "source_agent": F.lit("agent")}
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.concat(F.lit("L"), "o_custkey").alias("l"), "o_custkey", "o_orderstatus", F.floor("o_totalprice").alias("total"))
    orders = orders.withColumns(head(F.col("o")))
    customers = read(spark, sf_dir, "customer").withColumns(head(F.col("c_custkey")))
    suppliers = read(spark, sf_dir, "supplier").withColumns(head(F.col("s_suppkey")))
    fact = F.to_json(F.struct(F.lit("Total").alias("concept"), F.lit("USD").alias("unit"), F.col("total").cast("double").alias("value")))
    return {
        "sources": orders.withColumns({
            "provider": F.lit("SEC"), "document_type": F.lit("10-K"), "external_id": F.concat(F.lit("acc"), "o"), "source_url": F.lit("u"), "evidence_class": F.lit("OFFICIAL_RECORD"),
            "sha256": F.when(F.col("o") % 50 == 0, "").otherwise(C.sha256_hex(F.col("o").cast("string")))}),
        "entities": customers.withColumns({
            "candidate_key": F.concat(F.lit("k"), "c_custkey"), "entity_type": F.lit("COMPANY"), "canonical_name": F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")),
            "identifiers": ids("LEI", F.concat(F.lit("L"), "c_custkey"))}),
        "identifiers": suppliers.withColumns(said(F.lit("1")) | {
            "entity": end(ids("LEI", F.concat(F.lit("L"), "s_suppkey"))), "identifier": ids("TICKER", F.concat(F.lit("T"), F.col("s_suppkey") % 20))[0]}),
        "relationships": orders.withColumns(said(F.col("o").cast("string")) | {
            "subject": end(ids("LEI", F.col("l"))), "predicate": F.lit("RELATED_PARTY_TO"), "object": end(None, "GOVERNMENT_ENTITY", F.concat(F.lit("Office "), F.col("o_custkey") % 25))}),
        "events": orders.withColumns(said(F.col("o").cast("string")) | {
            "event_type": F.lit("ORDER"), "event_date": F.when(F.col("o") % 11 != 0, "2024-01-01").otherwise("soon"), "description": F.lit("d"),
            "participants": F.array(F.struct(end(ids("LEI", F.col("l"))).alias("entity"), F.lit("BUYER").alias("role")))}),
        "claims": orders.withColumns(said(F.col("o").cast("string")) | {
            "subject": end(ids("LEI", F.col("l"))), "claim_type": F.lit("FINANCIAL_FACT"), "statement": F.when(F.col("o") % 13 != 0, F.col("o_orderstatus")).otherwise(" "),
            "attributes": F.create_map(F.lit("fact"), fact)}),
    }


_IDENTIFIER = "struct<scheme:string,value:string,jurisdiction:string,source_document_id:string,valid_from:string,valid_to:string,attributes:map<string,string>>"


def _shown_batch(t: dict[str, DataFrame]) -> DataFrame:
    """(section, id, detail) of the tables of a batch."""
    rejected = F.concat_ws(":", "candidate_type", "seq", F.array_join("reasons", ";"))
    checked = F.concat_ws(":", "candidate_type", "candidate_key", F.col("run_id"))
    columns = {
        "entities": ("entity_id", F.col("canonical_name")), "identifiers": ("id", F.col("entity_id")), "relationships": ("id", F.try_element_at("attributes", F.lit("sourceAgent"))), "events": ("id", F.col("event_date")),
        "claims": ("id", F.col("evidence_assertion_id")), "facts": ("id", F.col("entity_id")), "evidence": ("id", F.col("subject_type")), "cases": ("id", F.col("existing_entity_id")),
        "resolutions": ("id", F.col("status")), "run_relationships": ("id", F.col("run_id")), "run_events": ("id", F.col("run_id")), "run_claims": ("id", F.col("run_id"))}
    parts = [t[k].select(F.lit(k).alias("section"), F.col(i).alias("id"), d.alias("detail")) for k, (i, d) in columns.items()]
    parts.append(t["rejections"].select(F.lit("rejections").alias("section"), rejected.alias("id"), F.col("run_id").alias("detail")))
    parts.append(t["validations"].select(F.lit("validations").alias("section"), checked.alias("id"), F.col("is_valid").cast("string").alias("detail")))
    parts.append(t["run_sources"].groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit("run_sources").alias("section"), F.col("run_id").alias("id"), F.col("n").cast("string").alias("detail")))
    return I.union([stage(p, "section") for p in parts])  # one after the other: as one plan they would broadcast all at once


_ENT = sid("entity", "'LEI:L' || c")
_SRC = sid("source", "'SEC:acc' || o || ':' || sha256(o::varchar)")
_OFFICE = sid("entity-unresolved", "'r' || (o % 3) || ':agent:GOVERNMENT_ENTITY:Office ' || (c % 25)")
_B_REL = sid("relationship", f"{_ENT} || ':RELATED_PARTY_TO:' || {_OFFICE} || ':' || {_SRC} || '::rec' || o")
_B_EVENT = sid("event", f"{_SRC} || ':rec' || o")
_B_CLAIM = sid("claim", f"{_ENT} || ':FINANCIAL_FACT:' || {_SRC} || ':rec' || o")
_PROVEN = lambda kind, key: sid("evidence", f"'{kind}:' || {key} || ':' || {_SRC} || ':order ' || o")
_TICKER = sid("identifier", "'TICKER:T' || t || ':'")
_WHOLE_BATCH = f"""with a as (select o_orderkey as o, o_custkey as c, 'r' || (o_orderkey % 3) as run, o_orderkey % 50 = 0 as bad, o_custkey % 7 = 0 as lost, o_orderkey % 11 = 0 as undated, o_orderkey % 13 = 0 as mute, cast(floor(o_totalprice) as bigint) as total from {{orders}}),
    a2 as (select * from a where not bad and not lost), ev as (select * from a2 where not undated), cl as (select * from a2 where not mute),
    s as (select s_suppkey as c, 'r' || (s_suppkey % 3) as run, s_suppkey % 20 as t, s_suppkey % 7 = 0 or s_suppkey not in (select c_custkey from {{customer}}) as lost, s_suppkey as seq, 1 as o from {{supplier}}),
    own as (select t, min(seq) as first, arg_min(c, seq) as owner from s where not lost group by t), sx as (select s.*, first, owner from s left join own using (t)),
    why as (select *, list_filter([case when lost then 'subject could not be resolved' end, case when bad then 'source document could not be resolved' end], lambda x: x is not null) as rel,
        list_filter([case when bad then 'source document could not be resolved' end, case when lost then 'one or more participants could not be resolved' end], lambda x: x is not null) as evt from a)
    select 'entities' as section, {_ENT} as id, name as detail from (select c_custkey as c, c_name as name from {{customer}} where c_custkey % 7 <> 0)
    union all select distinct 'entities', {_OFFICE}, 'Office ' || (c % 25) from a
    union all select 'identifiers', {sid('identifier', "'LEI:L' || c || ':'")}, {_ENT} from (select c_custkey as c from {{customer}} where c_custkey % 7 <> 0)
    union all select 'identifiers', {_TICKER}, {_ENT} from (select t, owner as c from own)
    union all select 'relationships', {_B_REL}, 'agent' from a2 union all select 'events', {_B_EVENT}, '2024-01-01' from ev union all select 'claims', {_B_CLAIM}, {_PROVEN("CLAIM", _B_CLAIM)} from cl
    union all select distinct 'facts', {sid('fact', f"{_ENT} || '::Total:USD::' || cast(total::double as varchar) || ':' || {_SRC}")}, {_ENT} from cl
    union all select 'evidence', {_PROVEN("RELATIONSHIP", _B_REL)}, 'RELATIONSHIP' from a2 union all select 'evidence', {_PROVEN("EVENT", _B_EVENT)}, 'EVENT' from ev union all select 'evidence', {_PROVEN("CLAIM", _B_CLAIM)}, 'CLAIM' from cl
    union all select distinct 'evidence', {_PROVEN("IDENTIFIER", _TICKER)}, 'IDENTIFIER' from sx where not lost and owner = c
    union all select distinct 'cases', {sid('resolution-case', f"'SEC:agent:TICKER:T' || t || ':' || {sid('entity', "'LEI:L' || owner")}")}, {sid('entity', "'LEI:L' || owner")} from sx where not lost and owner <> c
    union all select distinct 'resolutions', {sid('resolution', f"run || ':k' || c || ':' || {_ENT} || ':CREATED'")}, 'CREATED' from (select c_custkey as c, 'r' || (c_custkey % 3) as run from {{customer}} where c_custkey % 7 <> 0)
    union all select 'resolutions', {sid('resolution', "run || ':k' || c || '::REJECTED'")}, 'REJECTED' from (select c_custkey as c, 'r' || (c_custkey % 3) as run from {{customer}} where c_custkey % 7 = 0)
    union all select distinct 'resolutions', {sid('resolution', f"'r' || (o % 3) || ':agent:GOVERNMENT_ENTITY:Office ' || (c % 25) || ':' || {_OFFICE} || ':CREATED'")}, 'CREATED' from a
    union all select distinct 'resolutions', {sid('resolution', f"run || ':agent:TICKER:T' || t || ':' || {sid('entity', "'LEI:L' || owner")} || ':' || case when owner <> c then 'REVIEW_REQUIRED' when first < seq then 'RESOLVED' else 'CREATED' end")}, case when owner <> c then 'REVIEW_REQUIRED' when first < seq then 'RESOLVED' else 'CREATED' end from sx where not lost
    union all select 'run_relationships', {_B_REL}, run from a2 union all select 'run_events', {_B_EVENT}, run from ev union all select 'run_claims', {_B_CLAIM}, run from cl
    union all select 'rejections', 'SOURCE:' || o || ':SHA-256 must be a 64-character hex digest', run from a where bad
    union all select 'rejections', 'ENTITY:' || c_custkey || ':canonical name is required when no authoritative identifier resolves', 'r' || (c_custkey % 3) from {{customer}} where c_custkey % 7 = 0
    union all select 'rejections', 'IDENTIFIER:' || seq || ':entity could not be resolved', run from s where lost
    union all select 'rejections', 'RELATIONSHIP:' || o || ':' || array_to_string(rel, ';'), run from why where len(rel) > 0
    union all select 'rejections', 'EVENT:' || o || ':' || array_to_string(evt, ';'), run from why where len(evt) > 0 union all select 'rejections', 'EVENT:' || o || ':invalid event date', run from a2 where undated
    union all select 'rejections', 'CLAIM:' || o || ':statement is required', run from a where mute
    union all select 'rejections', 'CLAIM:' || o || ':' || case when bad then 'source document could not be resolved' else 'claim subject could not be resolved' end, run from a where not mute and (bad or lost)
    union all select 'validations', 'SOURCE:SEC:acc' || o || ':' || run, (not bad)::varchar from a
    union all select 'validations', 'ENTITY:k' || c_custkey || ':r' || (c_custkey % 3), 'true' from {{customer}} union all select distinct 'validations', 'ENTITY:agent:GOVERNMENT_ENTITY:Office ' || (c % 25) || ':' || run, 'true' from a
    union all select 'validations', 'IDENTIFIER:agent:TICKER:T' || t || ':' || run, (not arg_max(lost, seq))::varchar from s group by t, run
    union all select 'validations', 'RELATIONSHIP:rec' || o || ':' || run, (not bad and not lost)::varchar from a union all select 'validations', 'EVENT:rec' || o || ':' || run, (not bad and not lost)::varchar from a
    union all select 'validations', 'CLAIM:rec' || o || ':' || run, (not mute)::varchar from a
    union all select 'run_sources', run, count(*)::varchar from (select o, run from a where not bad union select 1, run from sx where not lost and owner = c) group by run"""


@query(_WHOLE_BATCH)
def ingest_batch(spark, sf_dir):
    from .operators.batch import ingest_batch as ingest

    return _shown_batch(ingest(_batch(spark, sf_dir), as_of="2024-01-01T00:00:00Z"))


# The same batch in three: customers, every second order as a source and a relationship; the other orders, events of the
# first ones and the first suppliers' tickers; all other events, claims and tickers. Later ones name sources, customers
# and offices that earlier ones stored.

def _thirds(spark, sf_dir) -> list[dict[str, DataFrame]]:
    b = _batch(spark, sf_dir)
    second, early = F.col("seq") % 2 == 1, F.col("seq") <= 40
    return [
        {"sources": b["sources"].filter(second), "entities": b["entities"], "relationships": b["relationships"].filter(second)},
        {"sources": b["sources"].filter(~second), "identifiers": b["identifiers"].filter(early), "relationships": b["relationships"].filter(~second), "events": b["events"].filter(second)},
        {"identifiers": b["identifiers"].filter(~early), "events": b["events"].filter(~second), "claims": b["claims"]}]


def _as_rows(batch: dict[str, DataFrame]) -> DataFrame:
    """Candidates as read_candidates takes them, each in a row of its own."""
    out = []
    for kind, df in batch.items():
        given = conform(df, kind)
        one = F.array(F.struct(*[c for c in given.columns if c not in ("run_id", "seq")]))
        out.append(given.select("run_id", F.col("seq").alias("batch_seq"), one.alias(kind)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def _stored_sections(store) -> dict[str, DataFrame]:
    from .operators.stored import entities_of

    tables = {name: store.read(name) for name in ("identifiers", "relationships", "events", "claims", "facts", "evidence", "cases", "resolutions", "rejections", "validations", "run_sources", "run_relationships", "run_events", "run_claims")}
    return tables | {"entities": entities_of(store)}


_STORED_BATCH = f"select section, case when section = 'rejections' then regexp_replace(id, ':[0-9]+:', ':') else id end as id, detail, count(*) as n from ({_WHOLE_BATCH}) group by all"


@query(_STORED_BATCH)
def stream_batches(spark, sf_dir):
    """Three micro-batches, each of files that came since the last one, into one store; every section of it."""
    from .sources.store import Store
    from .streaming import streams

    folder = new_folder(spark, "stream-batches")
    store, thirds = Store(spark, f"{folder}/store", buckets=8), [_as_rows(b) for b in _thirds(spark, sf_dir)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), thirds)
    for rows in thirds:
        none = {c: F.lit(None).cast(t) for c, t in whole.dtypes if c not in rows.columns}
        rows.withColumns(none).select(*whole.columns).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(whole.schema).parquet(f"{folder}/in")
        streams.stream_batches(arriving, store, f"{folder}/checkpoint", "2024-01-01T00:00:00Z").awaitTermination()
    shown = _shown_batch(_stored_sections(store))
    known = F.when(F.col("section") == "rejections", F.regexp_replace("id", ":[0-9]+:", ":")).otherwise(F.col("id"))
    return shown.withColumn("id", known).groupBy("section", "id", "detail").agg(F.count("*").alias("n"))


_LINKS = "select 'r' || (o_orderkey % 20) as run_id, 'O' || (o_orderkey % 900) as id from {orders}"


@query(f"select r.run_id, coalesce(a.n, 0)::bigint as n_sources, coalesce(b.n, 0)::bigint as n_events from (select 'r' || n_nationkey as run_id from {{nation}}) r left join (select run_id, count(distinct id) as n from ({_LINKS}) group by all) a using (run_id) left join (select 'r' || (o_custkey % 30) as run_id, count(*) as n from {{orders}} group by all) b using (run_id)")
def run_summary(spark, sf_dir):
    runs = read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("run_id"))
    return I.run_summary(runs, sources=B.bind(spark, sf_dir, _LINKS), events=B.bind(spark, sf_dir, "select 'r' || (o_custkey % 30) as run_id, 'E' || o_orderkey as id from {orders}"))


@query(f"""with links as ({_LINKS}), r as (select 'r' || n_nationkey as run_id, n_nationkey as k from {{nation}})
    select r.run_id, case when k % 5 = 4 then 'RUNNING' when k % 5 = 0 then 'FAILED' else 'COMPLETED' end as status, case when k % 5 = 0 then 'no page,timeout' else '' end as errors,
        case when k % 2 = 0 and k % 5 <> 4 then 'S' || k end as target_entity_id, '2024-01-01' as started_at, case when k % 5 <> 4 then '2024-01-02' end as completed_at, coalesce(a.n, 0)::bigint as documents_processed,
        coalesce(b.n, 0)::bigint as relationships_created, coalesce(c.n, 0)::bigint as events_created
    from r left join (select run_id, count(distinct id) as n from links group by all) a using (run_id) left join (select 'r' || (l_suppkey % 30) as run_id, count(distinct (l_orderkey, l_partkey, l_suppkey)) as n from {{lineitem}} group by all) b using (run_id)
        left join (select 'r' || (o_custkey % 30) as run_id, count(*) as n from {{orders}} group by all) c using (run_id)""")
def run_life_cycle(spark, sf_dir):
    """Runs as they begin and end: status, errors, target and what they touched; every fifth is still running."""
    k = F.col("n_nationkey")
    nations = read(spark, sf_dir, "nation").select(k, F.concat(F.lit("r"), k).alias("run_id"))
    runs = I.start_runs(nations.select("run_id", F.lit("filings").alias("agent_type"), F.lit(None).cast("map<string,string>").alias("metadata")), "2024-01-01")
    none = F.array().cast("array<string>")
    ends = nations.filter(k % 5 != 4).select("run_id", F.when(k % 5 == 0, "FAILED").otherwise("COMPLETED").alias("status"), F.when(k % 5 == 0, F.array(F.lit("no page"), F.lit("timeout"))).otherwise(none).alias("errors"), F.when(k % 2 == 0, F.concat(F.lit("S"), k)).alias("target_entity_id"))
    links = {
        "sources": B.bind(spark, sf_dir, _LINKS), "events": B.bind(spark, sf_dir, "select 'r' || (o_custkey % 30) as run_id, 'E' || o_orderkey as id from {orders}"),
        "relationships": B.bind(spark, sf_dir, "select 'r' || (l_suppkey % 30) as run_id, 'H' || l_orderkey || '-' || l_partkey || '-' || l_suppkey as id from {lineitem}")}
    done = I.finish_runs(runs, ends, links, "2024-01-02")
    return done.select("run_id", "status", F.array_join("errors", ",").alias("errors"), "target_entity_id", "started_at", "completed_at", "documents_processed", "relationships_created", "events_created")


@query("select 'relationships' as kind, 0::bigint as n union all select 'evidence', 0 union all select 'entities', 0")
def replay_is_noop(spark, sf_dir):
    def added(first: DataFrame, again: DataFrame, kind: str) -> DataFrame:
        new = stage_parts(lambda k, n: I.new_records(part_of(first, "id", k, n), part_of(again, "id", k, n)), n_parts(first, again), "added")
        return new.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")

    def stored() -> tuple[DataFrame, DataFrame]:
        found = _holdings(spark, sf_dir)
        return found["relationships"].select("id"), I.evidence_rows(found["all"], "RELATIONSHIP").select("id")

    a = [stage(df, "first") for df in stored()]
    b = stored()
    one = stage(R.resolve_entities(_named(spark, sf_dir)).select(F.col("entity_id").alias("id")), "first")
    two = R.resolve_entities(_named(spark, sf_dir)).select(F.col("entity_id").alias("id"))
    return I.union([added(*x) for x in ((a[0], b[0], "relationships"), (a[1], b[1], "evidence"), (one, two.distinct(), "entities"))])


_CHANGES = "select o_custkey as id, o_orderkey as seq from {orders}"


@query(f"""with o as ({_CHANGES}), old as (select id, min(seq) as seq from o where seq % 2 = 0 group by id)
    select * from old union all select id, min(seq) from o where seq % 2 = 1 and id not in (select id from old) group by id""")
def upsert_first(spark, sf_dir):
    rows = B.bind(spark, sf_dir, _CHANGES)
    return I.upsert_first(S.first_wins(rows.filter("seq % 2 = 0"), "id"), rows.filter("seq % 2 = 1"), order="seq")


@query(f"""with o as ({_CHANGES}), new as (select id, max(seq) as seq from o where seq % 2 = 1 group by id)
    select * from new union all select id, min(seq) from o where seq % 2 = 0 and id not in (select id from new) group by id""")
def upsert_last(spark, sf_dir):
    rows = B.bind(spark, sf_dir, _CHANGES)
    return I.upsert_last(S.first_wins(rows.filter("seq % 2 = 0"), "id"), rows.filter("seq % 2 = 1"), order="seq")


_SAID = "select 'Q' || o_orderkey as id, 'O' || o_orderkey as source_document_id, 'status ' || o_orderstatus as statement, cast(null as string) as evidence_assertion_id from {orders}"
_SAID_ID = sid("evidence", "'CLAIM:' || c.id || ':' || source_document_id || ':' || statement")


@query(f"""with e as ({B.EDGES}), v as ({B.EVENTS}), c as ({_SAID}) select subject_type, named, count(*) as n from (
        select distinct 'RELATIONSHIP' as subject_type, '' as named, id, source_document_id from e where extraction_method <> 'TABLE' and id not in (select id from e where extraction_method = 'TABLE')
        union all select distinct 'EVENT', '', id, source_document_id from v
        union all select 'CLAIM', substr({_SAID_ID}, 1, 1), c.id, source_document_id from c where o_key(c.id) % 3 <> 0) group by all""".replace("o_key(c.id)", "cast(substr(c.id, 2) as bigint)"))
def backfill_evidence(spark, sf_dir):
    more = {"evidence_class": F.lit("DERIVED"), "assertion_type": F.lit("REPORTED"), "evidence": F.lit("text"), "confidence": F.lit(1.0), "seq": F.lit(0).cast("long")}
    edges = B.bind(spark, sf_dir, B.EDGES).withColumns(more)
    events = B.bind(spark, sf_dir, B.EVENTS).withColumns(more | {"extraction_method": F.lit("TABLE")})
    claims = B.bind(spark, sf_dir, _SAID).withColumns({k: more[k] for k in ("assertion_type", "confidence", "seq")})
    third = claims.filter(F.substring("id", 2, 20).cast("long") % 3 == 0).withColumns({"evidence": F.col("statement"), "evidence_class": F.lit("DERIVED"), "extraction_method": F.lit("TABLE")})
    have = I.evidence_rows(edges.filter("extraction_method = 'TABLE'"), "RELATIONSHIP").unionByName(I.evidence_rows(third, "CLAIM"))
    added, named = I.backfill_evidence(have, edges, events, claims, B.bind(spark, sf_dir, B.SOURCES))
    rows = added.filter("subject_type != 'CLAIM'").select("subject_type", F.lit("").alias("named"))
    told = named.filter("evidence_assertion_id is not null").select(F.lit("CLAIM").alias("subject_type"), F.substring("evidence_assertion_id", 1, 1).alias("named"))
    return rows.unionByName(told).groupBy("subject_type", "named").agg(F.count("*").alias("n"))


_MARKED = f"select id, subject_entity_id, case when id like 'I%' then 'HOLDS_SECURITY' else predicate end as predicate, object_entity_id, source_document_id from ({B.EDGES})"


@query(f"""with left_ as (select * from ({_MARKED}) where not (id like 'I%1')) select 'edge ' || predicate as kind, count(*) as n from left_ group by 1
    union all select 'evidence', count(*) from left_ union all select 'links', count(*) from left_""")
def purge_superseded_holdings(spark, sf_dir):
    deep = F.create_map(F.lit("detail"), F.lit('{"securityEntityId":"x"}'))
    mark = F.when(F.substring(F.reverse("id"), 2, 1) == "1", deep).otherwise(F.create_map(F.lit("securityEntityId"), F.lit("x")))
    rows = B.bind(spark, sf_dir, _MARKED).withColumn("attributes", F.when(F.col("id").endswith("1"), mark).otherwise(F.create_map().cast("map<string,string>")))
    proof = rows.select(F.lit("RELATIONSHIP").alias("subject_type"), F.col("id").alias("subject_id"))
    t = I.purge_superseded_holdings(rows, B.bind(spark, sf_dir, B.NODES), proof, rows.select(F.lit("r").alias("run_id"), "id"))
    kinds = t["relationships"].select(F.concat(F.lit("edge "), "predicate").alias("kind"))
    return I.union([kinds, t["evidence"].select(F.lit("evidence").alias("kind")), t["run_relationships"].select(F.lit("links").alias("kind"))]).groupBy("kind").agg(F.count("*").alias("n"))


_FILED = "select 'B' || s_suppkey as id, 'S' || s_suppkey as subject_entity_id, case when s_suppkey % 3 = 0 then 'OTHER' else 'BENEFICIAL_OWNER_OF' end as predicate, 'N' || s_nationkey as object_entity_id, 'O' || (s_suppkey % 10) as source_document_id from {supplier}"


_OWNER_ROWS = f"""bad as (select id, subject_entity_id as s from ({_FILED}) where predicate = 'BENEFICIAL_OWNER_OF' and cast(substr(source_document_id, 2) as int) % 4 = 0
        and source_document_id <> 'O0' and cast(substr(subject_entity_id, 2) as int) % 5 <> 0),
    kept as (select s_suppkey from {{supplier}} where 'S' || s_suppkey not in (select s from bad) or s_suppkey % 11 = 0 or s_suppkey % 13 = 0)"""


@query(f"""with {_OWNER_ROWS} select 'edges' as kind, count(*) as n from ({_FILED}) where id not in (select id from bad)
    union all select 'evidence', count(*) from ({_FILED}) where id not in (select id from bad) union all select 'links', count(*) from ({_FILED}) where id not in (select id from bad)
    union all select 'entities', (select count(*) from kept) + (select count(*) from ({B.NODES}) where id not like 'S%')
    union all select 'resolutions', count(*) from {{supplier}} where 'S' || s_suppkey not in (select s from bad)""")
def purge_name_only_owners(spark, sf_dir):
    nodes, edges = B.bind(spark, sf_dir, B.NODES), B.bind(spark, sf_dir, _FILED)
    firms = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("S"), "s_suppkey").alias("entity_id"))
    t = I.purge_name_only_owners({
        "relationships": edges, "entities": nodes, "identifiers": firms.filter("s_suppkey % 5 = 0"), "sources": B.bind(spark, sf_dir, B.SOURCES), "participants": firms.filter("s_suppkey % 11 = 0"),
        "claims": firms.filter("s_suppkey % 13 = 0").withColumnRenamed("entity_id", "subject_entity_id"), "run_relationships": edges.select("id"),
        "evidence": edges.select(F.lit("RELATIONSHIP").alias("subject_type"), F.col("id").alias("subject_id")), "resolutions": firms.withColumnRenamed("entity_id", "proposed_entity_id")})
    shown = {"edges": t["relationships"], "evidence": t["evidence"], "links": t["run_relationships"], "entities": t["entities"], "resolutions": t["resolutions"].filter("proposed_entity_id is not null")}
    return I.union([df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in shown.items()])


# Graph --------------------------------------------------------------------------------------------------------------

@query(f"select id, case when cast(substr(id, 2) as bigint) % 3 <> 0 then 'late' else 'early' end as mark from ({B.NODES})")
def merge_graphs(spark, sf_dir):
    rows = B.bind(spark, sf_dir, B.NODES)
    key = F.substring("id", 2, 20).cast("long")
    early, late = rows.filter(key % 2 != 1).withColumn("mark", F.lit("early")), rows.filter(key % 3 != 0).withColumn("mark", F.lit("late"))
    return G.merge_graphs([rows.withColumn("mark", F.lit("early")), early, late]).select("id", "mark")


_WALK = f"(select subject_entity_id as src, object_entity_id as dst, id from ({B.EDGES}) union all select object_entity_id, subject_entity_id, id from ({B.EDGES}) where subject_entity_id <> object_entity_id)"
_REACH = f"""with recursive w as materialized (select distinct src, dst from {_WALK}),
    r as (select 'N' || n_nationkey as root, 'N' || n_nationkey as id, 0 as distance from {{nation}} union select root, dst, distance + 1 from r join w on src = r.id where distance < DEPTH),
    d as (select root, id, min(distance)::int as distance from r group by all)"""


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All nodes, all edges, and the nations as roots."""
    nodes, edges = B.bind(spark, sf_dir, B.NODES), B.bind(spark, sf_dir, B.EDGES)
    return nodes, edges, nodes.filter("entity_type = 'GOVERNMENT_ENTITY'").select(F.col("id").alias("root"))


@query(_REACH.replace("DEPTH", "4") + " select root, id, distance from d")
def traverse(spark, sf_dir):
    return G.traverse(*_graph(spark, sf_dir), 4)[0]


@query(_REACH.replace("DEPTH", "2") + f" select distinct root, w.id as edge_id from d join {_WALK} w on w.src = d.id where distance < 2")
def traverse_edges(spark, sf_dir):
    return G.traverse(*_graph(spark, sf_dir), 2)[1]


_BIG = f"(select subject_entity_id as src, object_entity_id as dst from ({B.EDGES}) union all select object_entity_id, subject_entity_id from ({B.EDGES}))"


@query(f"select distinct src as root, dst as id, 1::int as distance from {_BIG} where src like 'S%' union all select 'S' || s_suppkey, 'S' || s_suppkey, 0 from {{supplier}}")
def neighbors(spark, sf_dir):
    nodes, edges = B.bind(spark, sf_dir, B.NODES), B.bind(spark, sf_dir, B.EDGES)
    return G.neighbors(nodes, edges, nodes.filter("entity_type = 'COMPANY'").select(F.col("id").alias("root")))[0]


#: A hundred pairs: each nation and four customers.
_PAIRS = "select 'N' || n_nationkey as source, 'C' || ((n_nationkey * 3 + k * 37) % c + 1) as target from {nation} cross join (select count(*) as c from {customer}) x cross join (select r_regionkey as k from {region} where r_regionkey < 4) y"


def _level(k: int) -> str:
    before = " union all ".join(f"select source, here from l{n}" for n in range(k))
    return f"""l{k} as materialized (select source, dst as here, min(list_append(ranks, rank)) as ranks, arg_min(list_append(ids, w.id), list_append(ranks, rank)) as ids from l{k - 1} join w on src = here
        where (source, dst) not in ({before}) group by source, dst)"""


_HOPS = f"""with k as (select id, row_number() over (order by observed_at desc nulls last, id) as rank from ({B.EDGES})),
    w as materialized (select src, dst, min(rank) as rank, arg_min(id, rank) as id from {_WALK} join k using (id) group by src, dst), q as materialized (select distinct * from ({_PAIRS})),
    l0 as materialized (select distinct source, source as here, []::bigint[] as ranks, []::varchar[] as ids from q), {", ".join(_level(n) for n in (1, 2, 3, 4))},
    b as materialized (select * from l0 union all select * from l1 union all select * from l2 union all select * from l3 union all select * from l4)"""


def _found(spark, sf_dir) -> DataFrame:
    nodes, edges, _ = _graph(spark, sf_dir)
    return G.find_path(nodes, edges, B.bind(spark, sf_dir, _PAIRS))


@query(_HOPS + " select q.source, target, len(ids)::int as depth, array_to_string(ids, ',') as edges from q left join b on b.source = q.source and b.here = q.target")
def find_path(spark, sf_dir):
    step = F.when(F.col("edge_id").isNotNull(), F.struct("hop", "edge_id"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["edge_id"]), ",")
    return _found(spark, sf_dir).groupBy("source", "target", "depth").agg(path.alias("edges")).withColumn("edges", F.when(F.col("depth").isNotNull(), F.col("edges")))


@query(_REACH.replace("DEPTH", "3") + " select root, id, distance from d")
def traverse_whole(spark, sf_dir):
    return G.traverse(*_graph(spark, sf_dir), 3)[0]


@query(_REACH.replace("DEPTH", "2") + f" select root, count(distinct w.id) as n from d join {_WALK} w on w.src = d.id where distance < 2 group by root")
def traverse_edges_whole(spark, sf_dir):
    return G.traverse(*_graph(spark, sf_dir), 2)[1].groupBy("root").agg(F.count("*").alias("n"))


@query(_HOPS + """ select q.source, target, len(ids)::int as depth, case when len(ids) > 0 then h end::int as hop, ids[h + 1] as edge_id from q left join b on b.source = q.source and b.here = q.target, unnest(range(greatest(len(ids), 1))) t(h)""")
def find_path_whole(spark, sf_dir):
    return _found(spark, sf_dir).select("source", "target", "depth", "hop", "edge_id")


@query(f"""select entity_id, 'EVENT' as kind, event_date as date, event_id as record_id from (select distinct event_id, entity_id from ({B.PARTICIPANTS})) join ({B.EVENTS}) on id = event_id where event_date >= '1996-01-01'
    union all select entity_id, 'RELATIONSHIP', start, id from (select *, coalesce(valid_from, substr(observed_at, 1, 10)) as start, unnest(list_distinct([subject_entity_id, object_entity_id])) as entity_id from ({B.EDGES})) where not coalesce(coalesce(valid_to, start) < '1996-01-01', false)""")
def timeline(spark, sf_dir):
    return G.timeline(B.bind(spark, sf_dir, B.EDGES), B.bind(spark, sf_dir, B.EVENTS), B.bind(spark, sf_dir, B.PARTICIPANTS), date_from="1996-01-01")


@query(f"""select *, row_number() over (partition by entity_id order by coalesce(date, '') desc, kind, record_id) as rank from ({ORACLE_SQL['timeline']})""")
def ranked_timeline(spark, sf_dir):
    return G.ranked_timeline(timeline(spark, sf_dir))


_CAREER = ", ".join(f"'{p}'" for p in CAREER_PREDICATES)


@query(f"""with c as materialized (select subject_entity_id as p, object_entity_id as o, id, coalesce(valid_from, observed_at, '') as at, row_number() over (partition by subject_entity_id order by coalesce(valid_from, observed_at, ''), id) as n from ({B.CAREERS}) where predicate in ({_CAREER})),
    l as (select p, o, max(n) as n, count(*) as k, arg_max(id, n) as id from c group by all)
    select l.p as person_id, l.o as organization_id, l.id as edge_id, any_value(k) as n_assertions, arg_max(c.id, c.n) filter (c.n < l.n) as previous_edge_id, arg_min(c.id, c.n) filter (c.n > l.n) as next_edge_id from l left join c on c.p = l.p and c.o <> l.o group by l.p, l.o, l.id""")
def career_transitions(spark, sf_dir):
    edges = B.bind(spark, sf_dir, B.CAREERS)
    people = edges.select(F.col("subject_entity_id").alias("id")).distinct().withColumn("entity_type", F.lit("PERSON"))
    return G.career_transitions(people, edges)


_SEARCHED = f"select id, canonical_name, case when entity_type = 'COMPANY' then 'alias ' || id end as aliases, 'INTERNAL:' || id as identifiers from ({B.NODES})"
_SOUGHT = "select ' ' || n_name || ' ' as query from {nation} union all select 'small ring' from {region} union all select 'supplier#00000001' from {region} union all select 'c12' from {region} union all select '  ' from {region}"


@query(f"""select query, rank::int as rank, id, score::int as score from (select *, row_number() over (partition by query order by score desc, canonical_name, id) as rank from (select q.query, n.id, canonical_name, case when lower(canonical_name) = lower(q.query) then 100 when starts_with(lower(canonical_name), lower(q.query)) then 80 else 50 end as score
    from (select distinct trim(query) as query from ({_SOUGHT})) q join (select *, lower(canonical_name || ' ' || coalesce(aliases, '') || ' ' || identifiers || '  ') as t from ({_SEARCHED})) n on q.query <> '' and contains(t, lower(q.query)))) where rank <= 20""")
def search_entities(spark, sf_dir):
    nodes = B.bind(spark, sf_dir, _SEARCHED).withColumns({"ticker": F.lit(None).cast("string"), "tickers": F.lit(None).cast("string")})
    return G.search_entities(nodes, B.bind(spark, sf_dir, _SOUGHT))


_VISITS = "select user_id, ts as t, event_type as place from {events}"


@query(f"select user_id, string_agg(place, ',' order by t) as trail from (select *, row_number() over (partition by user_id order by t desc) as r from (select *, lag(place) over (partition by user_id order by t) as before from ({_VISITS})) where before is distinct from place) where r <= 12 group by user_id")
def traversal_trail(spark, sf_dir):
    return G.traversal_trail(B.bind(spark, sf_dir, _VISITS).withColumnRenamed("t", "at")).select("user_id", F.array_join("trail", ",").alias("trail"))


@query(f"""with n as ({B.NODES}), e as ({B.EDGES}), v as ({B.EVENTS}), s as ({B.SOURCES}) select 'entities' as statistic, '' as value, count(*) as n from n union all select 'relationships', '', count(*) from e union all select 'events', '', count(*) from v union all select 'facts', '', count(*) from {{orders}} where o_orderkey % 2 = 0 union all select 'rejected', '', count(*) from {{lineitem}} where l_linenumber = 2
    union all select 'llm', '', count(*) from e where extraction_method = 'LLM_STRUCTURED' union all select 'deterministic', '', (select count(*) from e where extraction_method <> 'LLM_STRUCTURED') + (select count(*) from v) + (select count(*) from {{orders}} where o_orderkey % 2 = 0)
    union all select 'people', '', count(*) from n where entity_type = 'PERSON' union all select 'organizations', '', count(*) from n where entity_type in ('ORGANIZATION', 'COMPANY') union all select 'funds', '', 0 union all select 'securities', '', count(*) from n where entity_type = 'SECURITY'
    union all select 'entity_type', entity_type, count(*) from n group by 2 union all select 'predicate', predicate, count(*) from e group by 2 union all select 'event_type', event_type, count(*) from v group by 2 union all select 'form', document_type, count(*) from s group by 2""")
def snapshot_stats(spark, sf_dir):
    nodes, edges, events = (B.bind(spark, sf_dir, t) for t in (B.NODES, B.EDGES, B.EVENTS))
    facts = B.bind(spark, sf_dir, "select 'Q' || o_orderkey as id from {orders} where o_orderkey % 2 = 0")
    rejected = B.bind(spark, sf_dir, "select l_orderkey as id from {lineitem} where l_linenumber = 2")
    return G.snapshot_stats(nodes, edges, events, facts, rejected, B.bind(spark, sf_dir, B.SOURCES))


@query(f"select 'sources' as kind, count(*) as n from ({B.SOURCES}) where provider <> 'TEST_FIXTURE' union all select 'entities', count(*) from ({B.NODES}) where not (id like '%7') union all select 'edges', count(*) from ({B.EDGES}) where source_document_id in (select id from ({B.SOURCES}) where provider <> 'TEST_FIXTURE')")
def exclude_fixtures(spark, sf_dir):
    nodes = B.bind(spark, sf_dir, B.NODES).withColumn("attributes", F.when(F.col("id").endswith("7"), '{"a":{"Fixture":true}}').otherwise('{"fixture":false}'))
    parts = G.exclude_fixtures(B.bind(spark, sf_dir, B.SOURCES), nodes, B.bind(spark, sf_dir, B.EDGES))
    rows = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in zip(("sources", "entities", "edges"), parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_FEW = f"select id from ({B.NODES}) where cast(substr(id, 2) as bigint) % 10 <> 3"


@query(f"""with n as materialized ({_FEW}) select 'edges' as kind, count(*) as n from ({B.EDGES}) where subject_entity_id in (select id from n) and object_entity_id in (select id from n)
    union all select 'events', count(*) from ({B.EVENTS}) where id not in (select event_id from ({B.PARTICIPANTS}) where entity_id not in (select id from n))
    union all select 'claims', count(*) from {{orders}} where o_orderkey % 4 = 0 or 'C' || o_custkey in (select id from n) union all select 'facts', count(*) from {{orders}} where 'C' || o_custkey in (select id from n)""")
def close_over_nodes(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("entity_id"))
    claims = orders.select(F.when(F.col("o_orderkey") % 4 != 0, F.col("entity_id")).alias("subject_entity_id"))
    parts = G.close_over_nodes(B.bind(spark, sf_dir, _FEW), B.bind(spark, sf_dir, B.EDGES), B.bind(spark, sf_dir, B.EVENTS), B.bind(spark, sf_dir, B.PARTICIPANTS), claims, orders)
    rows = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


_IDS = f"select id as entity_id, 'INTERNAL' as scheme, id as value from ({B.NODES}) union all select 'C' || c_custkey, 'LEI', c_mktsegment from {{customer}}"


@query(f"select n.id, ids as identifiers, aliases from ({B.NODES}) n left join (select entity_id as id, string_agg(scheme || ':' || value, '|' order by scheme || ':' || value) as ids from (select distinct * from ({_IDS})) group by all) using (id) left join (select 'S' || s_suppkey as id, 'a' || s_nationkey as aliases from {{supplier}}) using (id)")
def pack_identity(spark, sf_dir):
    aliases = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.concat(F.lit("a"), "s_nationkey").alias("alias"))
    return G.pack_identity(B.bind(spark, sf_dir, B.NODES), B.bind(spark, sf_dir, _IDS), aliases).select("id", "identifiers", "aliases")


# Sources, sinks and extraction --------------------------------------------------------------------------------------

@query("select 'r' || (o_custkey % 3) as run_id, row_number() over (order by o_custkey, o_orderkey) - 1 as seq, o_orderkey as external_id from {orders}")
def read_candidates(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("external_id")))).alias("sources"))
    batches = orders.select(F.concat(F.lit("r"), F.col("o_custkey") % 3).alias("run_id"), F.col("o_custkey").alias("batch_seq"), "sources")
    return T.read_candidates(batches)["sources"]


@query("select event_id, json_extract_string(p, '$.k') as k, case when event_id % 10 = 0 then p end as text from (select event_id, case when event_id % 10 = 0 then 'not json' else props end as p from {events}) where event_id % 10 <> 0 union all select event_id, null, 'not json' from {events} where event_id % 10 = 0")
def parse_json_fields(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "not json").otherwise(F.col("props")).alias("p"))
    return T.parse_json_fields(rows, "p").select("event_id", F.try_element_at("p", F.lit("k")).alias("k"), F.col("p_text").alias("text"))


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    nodes = B.bind(spark, sf_dir, B.NODES)
    sections = {"entities": nodes.withColumn("attributes", F.lit("{}")), "relationships": B.bind(spark, sf_dir, B.EDGES), "sources": B.bind(spark, sf_dir, B.SOURCES), "events": B.bind(spark, sf_dir, B.EVENTS), "participants": B.bind(spark, sf_dir, B.PARTICIPANTS)}
    return sections | {"identifiers": nodes.select(F.col("id").alias("entity_id"), F.lit("INTERNAL").alias("scheme"), F.col("id").alias("value")), "aliases": nodes.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("alias"))}


@query(f"select e.id, s.document_type as source_form, s.title as source_title, a.canonical_name as subject_name, b.canonical_name as object_name from ({B.EDGES}) e join ({B.SOURCES}) s on s.id = e.source_document_id and provider <> 'TEST_FIXTURE' join ({B.NODES}) a on a.id = e.subject_entity_id join ({B.NODES}) b on b.id = e.object_entity_id")
def export_canonical_graph(spark, sf_dir):
    return T.export_canonical_graph(_tables(spark, sf_dir))["edges"].select("id", "source_form", "source_title", "subject_name", "object_name")


@query(f"select v.id, string_agg(p, '|' order by p) as participants from ({B.EVENTS}) v left join (select distinct event_id, entity_id || ':' || role as p from ({B.PARTICIPANTS})) x on x.event_id = v.id group by v.id")
def export_events(spark, sf_dir):
    return T.export_canonical_graph(_tables(spark, sf_dir), include_fixtures=True)["events"].select("id", "participants")


def _rooted(spark, sf_dir, run: str | None) -> DataFrame:
    """(section, id, detail) of every section of what touches the first supplier."""
    t = _tables(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("O"), "o_orderkey").alias("o"))
    third = orders.filter("o_orderkey % 3 = 0")
    t |= {
        "facts": B.bind(spark, sf_dir, "select 'A' || s_suppkey || '-' || o_orderkey as id, 'S' || s_suppkey as entity_id, 'O' || o_orderkey as source_document_id from {supplier} join {orders} on o_orderkey % 97 = s_suppkey % 97"),
        "rejections": orders.select(F.concat(F.lit("J"), "o").alias("id"), F.concat(F.lit("r"), F.col("o_orderkey") % 5).alias("run_id")),
        "run_sources": third.select(F.lit("r1").alias("run_id"), F.col("o").alias("id")), "run_events": third.select(F.lit("r1").alias("run_id"), F.concat(F.lit("E"), "o_orderkey").alias("id")),
        "run_relationships": t["relationships"].filter("id like 'F%' or id like 'I1-%'").select(F.lit("r1").alias("run_id"), "id")}
    found = T.export_entity_graph(t, "S1", run)
    detail = {"nodes": "identifiers", "edges": "object_name", "events": "participants", "facts": "entity_id", "sources": "title", "rejections": "run_id"}
    rows = [found[k].select(F.lit(k).alias("section"), "id", F.col(c).alias("detail")) for k, c in detail.items()]
    plain = found["stats"].filter("value = ''").select(F.lit("stats").alias("section"), F.col("statistic").alias("id"), F.col("n").cast("string").alias("detail"))
    return I.union([*rows, plain.filter("id in ('entities', 'relationships', 'events', 'facts', 'rejected')")])


def _rooted_sql(run: bool) -> str:
    edges = "id like 'F%' or id like 'I1-%'" if run else "subject_entity_id = 'S1' or object_entity_id = 'S1'"
    mine = " and cast(substr({}, 2) as bigint) % 3 = 0" if run else ""
    return f"""with people as ({B.PARTICIPANTS}), src as ({B.SOURCES}), nodes as ({B.NODES}),
        e as (select e.id, subject_entity_id, object_entity_id, b.canonical_name as name from (select * from ({B.EDGES}) where {edges}) e join src on src.id = source_document_id join nodes a on a.id = subject_entity_id join nodes b on b.id = object_entity_id),
        v as (select id from ({B.EVENTS}) where id in (select event_id from people where entity_id = 'S1'){mine.format("id")}),
        n as (select subject_entity_id as id from e union select object_entity_id from e union select entity_id from people where event_id in (select id from v) union select 'S1'),
        f as (select 'A' || s_suppkey || '-' || o_orderkey as id from {{supplier}} join {{orders}} on o_orderkey % 97 = s_suppkey % 97 where s_suppkey = 1{mine.format("'O' || o_orderkey")}),
        j as (select 'JO' || o_orderkey as id, 'r' || (o_orderkey % 5) as run_id from {{orders}}{" where o_orderkey % 5 = 1" if run else ""})
        select 'nodes' as section, id, 'INTERNAL:' || id as detail from n join nodes using (id) union all select 'edges', id, name from e
        union all select 'events', v.id, string_agg(p, '|' order by p) from v join (select distinct event_id, entity_id || ':' || role as p from people) x on x.event_id = v.id group by v.id
        union all select 'facts', id, 'S1' from f union all select 'sources', id, title from src where true{mine.format("id")} union all select 'rejections', id, run_id from j
        union all select 'stats', 'entities', (select count(*) from n join nodes using (id))::varchar union all select 'stats', 'relationships', (select count(*) from e)::varchar
        union all select 'stats', 'events', (select count(*) from v)::varchar union all select 'stats', 'facts', (select count(*) from f)::varchar union all select 'stats', 'rejected', (select count(*) from j)::varchar"""


@query(_rooted_sql(False))
def export_entity_graph(spark, sf_dir):
    return _rooted(spark, sf_dir, None)


@query(_rooted_sql(True))
def export_entity_graph_of_run(spark, sf_dir):
    return _rooted(spark, sf_dir, "r1")


@query(f"""with s as ({B.SOURCES}), r as (select * from s where provider <> 'TEST_FIXTURE'), n as (select id, canonical_name from ({B.NODES})), e as (select * from ({B.EDGES}) where source_document_id in (select id from r))
    select 'nodes' as section, 'INTERNAL' as detail, count(*) as n from n union all select 'edges', source_form, count(*) from (select document_type as source_form from e join r on r.id = source_document_id) group by 2
    union all select 'events', provider, count(*) from ({B.EVENTS}) v join r on r.id = source_document_id group by 2 union all select 'sources', provider, count(*) from r group by 2
    union all select 'claims', document_type, count(*) from {{orders}} join r on r.id = 'O' || o_orderkey group by 2 union all select 'facts', '', count(*) from {{orders}} join r on r.id = 'O' || o_orderkey
    union all select 'evidence', 'order ' || (o_orderkey % 10), count(*) from {{orders}} join r on r.id = 'O' || o_orderkey group by 2
    union all select 'stats', 'relationships', count(*) from e union all select 'stats', 'claims', count(*) from {{orders}} join r on r.id = 'O' || o_orderkey""")
def export_sections(spark, sf_dir):
    t = _tables(spark, sf_dir)
    records = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("O"), "o_orderkey").alias("source_document_id"), F.concat(F.lit("C"), "o_custkey").alias("entity_id"), F.concat(F.lit("C"), "o_custkey").alias("subject_entity_id"),
        F.concat(F.lit("order "), F.col("o_orderkey") % 10).alias("evidence"))
    found = T.export_canonical_graph(t | {"claims": records, "facts": records, "evidence": records})
    what = {"nodes": F.substring("identifiers", 1, 8), "edges": F.col("source_form"), "events": F.col("source_provider"), "sources": F.col("provider"), "claims": F.col("source_type"), "facts": F.lit(""), "evidence": F.col("evidence")}
    rows = [found[k].groupBy(c.alias("detail")).agg(F.count("*").alias("n")).select(F.lit(k).alias("section"), "detail", "n") for k, c in what.items()]
    stats = found["stats"].filter("statistic in ('relationships', 'claims')").select(F.lit("stats").alias("section"), F.col("statistic").alias("detail"), "n")
    return I.union([*rows, stats])


@query(f"""with o as ({_CHANGES}), old as (select id, min(seq) as seq from o where seq % 3 = 0 group by id),
        one as (select * from old union all select id, min(seq) from o where seq % 3 = 1 and id not in (select id from old) group by id)
    select 'first' as rule, * from one union all select 'last', * from (select id, max(seq) as seq from o where seq % 3 <> 2 group by id)""")
def write_canonical(spark, sf_dir):
    rows, folder = B.bind(spark, sf_dir, _CHANGES), new_folder(spark, "canonical")
    out = []
    for rule in ("first", "last"):
        path, last = f"{folder}/{rule}", rule == "last"
        T.write_canonical(spark, rows.filter("seq % 3 = 0"), path, 1, last=last, order="seq")
        more = rows.filter("seq % 3 = 1") if not last else rows.filter("seq % 3 != 2")
        T.write_canonical(spark, more, path, 2, T.read_canonical(spark, path), last=last, order="seq")
        out.append(T.read_canonical(spark, path).select(F.lit(rule).alias("rule"), "id", "seq"))
    return I.union(out)




def _filings(spark, sf_dir) -> DataFrame:
    row = F.concat(F.lit('<tr class="r"><td><b>'), "s_name", F.lit("</b> &amp;amp; Sons  LLC</td><TD> N"), F.col("s_suppkey") % 7, F.lit("&nbsp;</TD></tr>"))
    rows = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("rows"), F.min("s_name").alias("least"))
    html = F.concat(F.lit("<table><tr><th>Name of Subsidiary</th><th>Jurisdiction</th></tr>"), F.array_join(F.transform("rows", lambda x: x["row"]), ""), F.lit("<tr><td>12</td></tr><tr><td>"), "least", F.lit(" &amp;amp; sons LLC</td></tr></table>"))
    return rows.select("doc_id", html.alias("html"))


_ROWS = "(select s_nationkey as doc_id, row_number() over (partition by s_nationkey order by s_suppkey) as pos, s_name || ' & Sons LLC' as name, 'N' || (s_suppkey % 7) as jurisdiction from {supplier} union all select s_nationkey, count(*) + 2, min(s_name) || ' & sons LLC', null from {supplier} group by 1)"


@query(f"select doc_id, pos::int as pos, name, jurisdiction, concat_ws(' — ', name, jurisdiction) as evidence from {_ROWS}")
def parse_subsidiaries(spark, sf_dir):
    return X.parse_subsidiaries(_filings(spark, sf_dir))


@query(f"select doc_id, pos::int as pos, name, jurisdiction from {_ROWS} qualify row_number() over (partition by doc_id, lower(name) order by pos) = 1")
def unique_subsidiaries(spark, sf_dir):
    return X.unique_subsidiaries(X.parse_subsidiaries(_filings(spark, sf_dir))).select("doc_id", "pos", "name", "jurisdiction")


@query(f"""select {sid('entity', "'INTERNAL:filing:' || doc_id || ':' || pos")} as subject_entity_id, {sid('entity', "'INTERNAL:filing:' || doc_id")} as object_entity_id, 'SUBSIDIARY_OF' as predicate, concat_ws(' — ', name, jurisdiction) as evidence
    from {_ROWS} qualify row_number() over (partition by doc_id, lower(name) order by pos) = 1""")
def filings_to_graph(spark, sf_dir):
    from .operators.batch import ingest_batch

    tables = ingest_batch(X.filing_candidates(_filings(spark, sf_dir), "filings"), as_of="2024-01-01T00:00:00Z")
    return tables["relationships"].select("subject_entity_id", "object_entity_id", "predicate", "evidence")


# Streams ------------------------------------------------------------------------------------------------------------

def _stream(spark, sf_dir, table: str) -> DataFrame:
    """The table as a file stream; the pattern makes a single file and a folder alike."""
    return spark.readStream.schema(read(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parque[t]")


@query("select o_custkey as id, min(o_orderkey) as seq, arg_min(o_orderstatus, o_orderkey) as status from {orders} group by o_custkey")
def stream_ingest(spark, sf_dir):
    from .streaming import streams

    folder = new_folder(spark, "ingest")
    rows = _stream(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    streams.stream_ingest(rows, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return streams.canonical_state(spark.read.option("basePath", f"{folder}/table").parquet(f"{folder}/table/batch=*"))


@query(ORACLE_SQL["traversal_trail"])
def stream_trail(spark, sf_dir):
    from .streaming import streams

    folder = new_folder(spark, "trail")
    trails = streams.stream_trail(_stream(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.col("event_type").alias("place")))
    keep = lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/table/batch={k}")
    trails.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/table").parquet(f"{folder}/table/batch=*")
    return rows.groupBy("user_id").agg(F.max_by("trail", "batch").alias("trail")).select("user_id", F.array_join("trail", ",").alias("trail"))
