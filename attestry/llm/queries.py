"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .exact_dedup import exact_dedup
from .licenses import PHRASES, TEMPLATES, block_words, run_length, runs, scan_licenses
from .mixing import DOMAINS, mix
from .ngram_join import near_duplicates
from .packing import pack
from .prefix_trie import conversation_trie
from .quality import classify_quality
from .secrets import scan_secrets
from .shared import table
from .sharding import assign_shards
from .substrings import remove_repeats
from .suffixes import remove_repeated_bytes
from .topk import top_k


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(DOMAINS)], "rate", "copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_exact_dedup, op3_substring_dedup, op4_license_scan, op5_top_k, op6_sharding, op7_packing, op8_mixing, op9_quality, op10_secret_scan, op11_collocations, op12_prefix_trie, op13_suffix_dedup)}

_PLACES = " union all ".join(f"select doc_id, k, i, '{label}' as label from w, range(len(ws)) r(i) where " + " and ".join(f"ws[i + {j + 1}] = '{x}'" for j, x in enumerate(phrase.split())) for phrase, label in PHRASES)
_TEMPLATES = ", ".join(f"('{name}', string_split('{must}', ' '), list_distinct(string_split('{b'|'.join(runs(text.encode().split(), run_length(text))).decode()}', '|')), {block_words(text)}, {run_length(text)})" for name, must, text in TEMPLATES)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LICENSES = rf"""
    with t as (select row_number() over () as k, doc_id, translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}') as t from documents),
    w as materialized (select *, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) as ps from (select k, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from t)),
    places as ({_PLACES}),
    base as (select k, count(*) as n, min(i) as lo, max(i) as hi, list(distinct label) as labels from places group by k),
    able as (select k, ws, case run when 2 then ps else ws end as xs, name, must, tw, size, run from w, (values {_TEMPLATES}) v(name, must, tw, size, run)
        where list_has_all(ws, must) and len(list_intersect(case run when 2 then ps else ws end, tw)) >= ceil(0.8 * len(tw) - 1e-9)),
    blocks as (select k, name, must, tw, list_slice(ws, p + 1, p + size) as b, list_slice(xs, p + 1, p + size - run + 1) as x from able, range(0, greatest(len(ws) - size, 0) + 1) r(p)),
    met as (select k, name, len(list_intersect(x, tw)) / len(tw) as share from blocks where list_has_all(b, must) and len(list_intersect(x, tw)) >= ceil(0.8 * len(tw) - 1e-9)),
    more as (select k, list(distinct name) as labels, max(share) as best from met group by k)
    select w.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, lo::bigint as first_word, hi::bigint as last_word,
        coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') as labels,
        case when n > 0 then 1.0 else coalesce(best, 0) end::double as score
    from w left join base using (k) left join more using (k)
"""

_SHINGLES = rf"""
    with recursive t as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}'), '[^\x20\x09-\x0D]+') as ws from documents),
    s as materialized (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) end) as gs from t),
    g as materialized (select doc_id, len(gs) as n, unnest(gs) as g from s),
    pairs as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as k from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
    links as materialized (select x, y from pairs where 100 * k >= 80 * (nx + ny - k)),
    edges as materialized (select x, y from links union select y, x from links),
    reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x),
    least_of as (select x as doc_id, min(y) as y from reach group by x)
    select doc_id, len(gs)::bigint as n_shingles, coalesce(least(doc_id, y), doc_id) as component_id from s left join least_of using (doc_id)
"""

_STEP = "xor(x >> 1, 3988292384 * (x & 1))"
_TRIE = rf"""
    with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as r, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    crc as (select c, n, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''), lambda b: [ascii(b)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, b: case when b >= 0 then xor(x, b) else {_STEP} end), 4294967295) % 4 as h from (select c, count(*) as n from t group by c)),
    mixed as (select crc.c, 0 as own, r, role, text from crc join t on t.c = crc.c - crc.c % 20 and r <= h union all select crc.c, 1, r, role, text from crc join t on t.c = crc.c and r > h),
    deep as (select c, row_number() over (partition by c order by own, r) as d, role, text from mixed),
    paths as materialized (select c, d, md5(string_agg(md5(role) || md5(text), '') over (partition by c order by d)) as p, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w from deep union all select c, 0, '', 0 from crc),
    known as materialized (select *, lag(p) over (partition by c order by d) as q, d = max(d) over (partition by c) as is_last from paths),
    nodes as materialized (select p, any_value(d) as depth, any_value(q) as q, any_value(w) as w, count(*) as n, min(c) as c, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (is_last), '')) as ends from known group by p),
    kids as (select q as p, count(*) as k from nodes where q is not null group by q),
    sums as (select known.p, count(*) filter (k is null) as leaves, sum((n - 1) * nodes.w) as saved from nodes left join kids using (p) join known on known.c = nodes.c and known.d <= nodes.depth group by known.p)
    select x.c as conv_id, x.depth::bigint as depth, y.c as parent_conv_id, x.n::bigint as n_convs, coalesce(k, 0)::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, x.ends as ends_sha256
    from nodes x join sums using (p) left join kids using (p) left join nodes y on x.q = y.p
"""

ORACLE_SQL = {
    "op1_ngram_join": _SHINGLES,
    "op3_substring_dedup": r"""
        with t as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        w as (select k, i, list_slice(ws, i + 1, i + 35) as win from t, range(0, greatest(len(ws) - 34, 0)) r(i)),
        rep as (select k, i from (select k, i, count(*) over (partition by win) as n from w) where n > 1),
        gone as (select distinct k, i + j as p from rep, range(35) r(j)),
        g as (select k, list(p) as gone from gone group by k)
        select doc_id, len(ws)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
            sha256(array_to_string(case when gone is null then ws else list_filter(ws, lambda x, i: not list_contains(gone, i - 1)) end, ' ')) as kept_sha256
        from t left join g using (k)
    """,
    "op4_license_scan": _LICENSES,
    "op5_top_k": """
        with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
            where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
        select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
    """,
    "op2_exact_dedup": r"""
        with t as (select doc_id, coalesce(text, '') as txt, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents),
        g as (select *, first_value(doc_id) over (partition by bare order by length(txt) desc, doc_id) as keep_id, count(*) over (partition by bare) as group_size from t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256 from g
    """,
    "op11_collocations": rf"""
        with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}') as t from documents),
        p as (select lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) as p from t),
        w as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') as ws from p),
        total as (select lang, sum(len(ws)) as n from w group by lang),
        known as materialized (select lang, x, count(*) as f from (select lang, list_slice(ws, i, i + m - 1) as x from w, range(1, 5) a(m), range(1, greatest(len(ws) - m + 2, 1)) r(i)) group by lang, x having count(*) >= 30),
        cuts as (select c.lang, c.x, c.f as a, k, l.f as l, r.f as r, (2000000::hugeint * c.f) // (l.f + r.f) as score from known c, range(1, 4) b(k), known l, known r
            where k < len(c.x) and l.lang = c.lang and l.x = list_slice(c.x, 1, k) and r.lang = c.lang and r.x = list_slice(c.x, k + 1, len(c.x))),
        best as (select * from (select *, row_number() over (partition by lang, x order by score, k) as first from cuts) where first = 1),
        inside as (select lang, list_slice(x, i, i + m - 1) as x, max(f) as longer from known, range(2, 4) a(m), range(1, greatest(len(x) - m + 2, 1)) r(i) where len(x) > m group by all),
        named as (select best.*, array_to_string(x, ' ') as phrase from best left join inside using (lang, x) where longer is null or 100 * longer < 80 * a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from named)
        select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked join total using (lang) where rank <= 2000
    """,
    "op12_prefix_trie": _TRIE,
    "op13_suffix_dedup": """
        with t as (select row_number() over () as k, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        cut as materialized (select k, 256 * j as base, substr(h, 512 * j + 1, 910) as s from t, range(0, greatest(length(h) // 2 - 199, 0) // 256 + 1) r(j)),
        w as (select k, base + i as i, md5(substr(s, 2 * i + 1, 400)) as m from cut, range(0, 256) r(i) where length(s) >= 2 * i + 400),
        rep as (select k, i from (select k, i, count(*) over (partition by m) as n from w) where n > 1),
        apart as (select k, i, case when i - lag(i) over (partition by k order by i) <= 200 then 0 else 1 end as new from rep),
        islands as (select k, i, sum(new) over (partition by k order by i) as g from apart),
        runs as (select k, g, min(i) as a, max(i) + 200 as b from islands group by k, g),
        gaps as (select k, a, b, lag(b, 1, 0) over (partition by k order by a) as since from runs),
        kept as (select k, count(*) as n, sum(b - a) as gone, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as left_hex from gaps join t using (k) group by k)
        select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(left_hex, h))) as kept_sha256
        from t left join kept using (k)
    """,
}
