"""The driver's tables as candidates and as a canonical graph.

Texts hold {table} where a table's name stands; Spark fills in DataFrames, other engines the names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = """
    select 'C' || c_custkey as id, 'PERSON' as entity_type, c_name as canonical_name from {customer}
    union all select 'S' || s_suppkey, 'COMPANY', s_name from {supplier}
    union all select 'P' || p_partkey, 'SECURITY', p_name from {part}
    union all select 'N' || n_nationkey, 'GOVERNMENT_ENTITY', n_name from {nation}
"""
EDGES = """
    select 'H' || l_orderkey || '-' || l_partkey || '-' || l_suppkey as id, 'C' || o_custkey as subject_entity_id, 'HOLDS_SECURITY' as predicate, 'P' || l_partkey as object_entity_id,
        cast(cast(o_orderdate as date) as string) as valid_from, case when l_linenumber > 1 then cast(cast(l_shipdate as date) as string) end as valid_to, cast(cast(l_shipdate as date) as string) || 'T00:00:00Z' as observed_at, 'O' || o_orderkey as source_document_id,
        case when l_linenumber = 3 then 'LLM_STRUCTURED' else 'TABLE' end as extraction_method, l_extendedprice as amount
    from {lineitem} join {orders} on l_orderkey = o_orderkey
    union all select 'I' || p || '-' || s, 'P' || p, 'ISSUED_BY', 'S' || s, null, null, '2000-01-01T00:00:00Z', 'O0', 'TABLE', null from (select distinct l_partkey as p, l_suppkey as s from {lineitem})
    union all select 'F' || s_suppkey, 'N' || s_nationkey, 'FUNDING_AGENCY_OF', 'S' || s_suppkey, '1995-01-01', null, null, 'O1', 'TABLE', null from {supplier}
"""
SOURCES = """
    select 'O' || o_orderkey as id, case when o_orderkey % 50 = 0 then 'TEST_FIXTURE' else 'SEC' end as provider, case when o_orderkey % 4 = 0 then 'SC 13G' else o_orderpriority end as document_type, 'order ' || o_orderkey as title, 'acc' || o_orderkey as accession_number,
        cast(cast(o_orderdate as date) as string) as filed_at, 'OFFICIAL_RECORD' as evidence_class from {orders}
"""
EVENTS = """
    select 'E' || o_orderkey as id, 'ORDER_' || o_orderstatus as event_type, cast(cast(o_orderdate as date) as string) as event_date, 'O' || o_orderkey as source_document_id, o_totalprice as amount from {orders}
"""
PARTICIPANTS = """
    select 'E' || o_orderkey as event_id, 'C' || o_custkey as entity_id, 'BUYER' as role from {orders}
    union all select 'E' || o, 'S' || s, 'SELLER' from (select distinct l_orderkey as o, l_suppkey as s from {lineitem}) join {orders} on o = o_orderkey
"""
CAREERS = """
    select 'W' || event_id as id, 'U' || user_id as subject_entity_id, case when event_id % 5 = 0 then 'DIRECTOR_OF' when event_id % 13 = 0 then 'PARENT_OF' else 'WORKED_AT' end as predicate, 'T' || event_type as object_entity_id,
        case when event_id % 3 <> 0 then cast(cast(ts as date) as string) end as valid_from, cast(null as string) as valid_to, cast(cast(ts as date) as string) as observed_at from {events}
"""
#: Entity candidates with clashes: shared identifiers, repeated keys, missing names.
CANDIDATES = """
    select o_orderkey as seq, 'r' || (o_orderkey % 3) as run_id, case when o_orderkey % 2 = 0 then 'k' || o_custkey end as candidate_key, 'agent' || (o_custkey % 2) as source_agent,
        case o_custkey % 4 when 0 then 'COMPANY' when 1 then 'ORGANIZATION' when 2 then 'PERSON' else 'FUND' end as entity_type,
        case when o_orderkey % 11 = 0 then null when o_orderkey % 97 = 0 then '' else 'Name  ' || (o_custkey + o_orderkey % 2) end as canonical_name,
        case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then 'TICKER' else 'INTERNAL' end as s1, 'c' || o_custkey as v1, case when o_orderkey % 3 = 0 then 'LEI' end as s2, 'L' || (o_custkey % 500) as v2,
        case when o_orderkey % 6 = 0 then null else 'J' || (o_orderkey % 4) end as jurisdiction, cast((o_orderkey % 10) / 10.0 as double) as confidence, case when o_orderkey % 3 = 1 then 'a' || (o_orderkey % 5) end as alias
    from {orders}
"""


def bind(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def plain(text: str) -> str:
    """The text for an engine where the tables have their own names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


ID = "struct<scheme:string,value:string,jurisdiction:string>"


def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CANDIDATES with identifiers, aliases and attributes as nested columns."""
    rows = bind(spark, sf_dir, CANDIDATES)
    ids = F.filter(F.array(*[F.struct(F.col(f"s{k}").alias("scheme"), F.col(f"v{k}").alias("value"), F.lit(None).cast("string").alias("jurisdiction")) for k in (1, 2)]), lambda x: x["scheme"].isNotNull())
    tags = F.create_map(F.lit("last"), F.col("seq").cast("string"), F.concat(F.lit("m"), F.col("seq") % 3), F.when(F.col("seq") % 4 != 0, F.col("source_agent")))
    return rows.withColumns({"identifiers": ids, "aliases": F.when(F.col("alias").isNotNull(), F.array("alias")), "attributes": tags, "status": F.lit(None).cast("string")}).drop("s1", "v1", "s2", "v2", "alias")
