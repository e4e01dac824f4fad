"""Column functions: identities, names, registry numbers, HTML and XML text, lenient numbers, edges.

All are built-in expressions but for Unicode normalisation and the single-pass decoding of HTML entities, which are
Arrow-batched helpers that only get the rows that need them.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the data's producers define it: ASCII space and controls 09-0D, Unicode spaces, U+FEFF.
WS = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_PY_WS = re.compile("[\t\n\x0b\f\r    -     　﻿]+")
#: The entity names that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—"}
_ENTITY = re.compile(r"&(#x?[0-9a-f]+|[a-z]+);", re.IGNORECASE | re.ASCII)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def stable_id(namespace: str, *parts: Column) -> Column:
    """A UUID-shaped id of namespace:part:part...; a missing part counts as empty."""
    h = sha256_hex(F.concat_ws(":", F.lit(namespace), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


@F.pandas_udf(StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else _PY_WS.sub(" ", re.sub("&amp;", "&", unicodedata.normalize("NFKC", s), flags=re.I)).strip(" "))


def normalize_name(c: Column) -> Column:
    """NFKC, &amp; to &, white space to single spaces, trimmed. ASCII rows stay in the JVM."""
    ascii_only = ~c.rlike("[^\\x00-\\x7f]")
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, "(?i)&amp;", "&"), f"[{WS}]+", " "))
    return F.when(ascii_only, plain).otherwise(_nfkc(F.when(~ascii_only, c)))


def normalized_alias(c: Column) -> Column:
    return F.lower(normalize_name(c))


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def is_valid_cik(c: Column) -> Column:
    return F.coalesce(F.length(digits(c)).between(1, 10), F.lit(False))


def normalize_cik(c: Column) -> Column:
    """Ten digits; null where there is none or there are more."""
    return F.when(is_valid_cik(c), F.lpad(digits(c), 10, "0"))


def normalize_accession(c: Column) -> Column:
    """Eighteen digits as 10-2-6; null for any other number of digits."""
    d = digits(c)
    return F.when(F.length(d) == 18, F.concat_ws("-", F.substring(d, 1, 10), F.substring(d, 11, 2), F.substring(d, 13, 6)))


def accession_no_dashes(c: Column) -> Column:
    return F.replace(normalize_accession(c), F.lit("-"), F.lit(""))


def accession_filer_cik(c: Column) -> Column:
    return F.substring(normalize_accession(c), 1, 10).cast("long").cast("string")


def company_slug(c: Column) -> Column:
    spelled = F.replace(F.lower(normalize_name(c)), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), "^-|-$", "")


#: A character reference with more digits than this is beyond Unicode in any base.
MOST_DIGITS = 7


def _code_point(token: str) -> int | None:
    """The number of #123 or #x1f; None if it is no character."""
    hexadecimal = token[1:2] in ("x", "X")
    digits = token[2:] if hexadecimal else token[1:]
    if not digits or not (hexadecimal or digits.isdigit()) or len(digits.lstrip("0")) > MOST_DIGITS:
        return None
    number = int(digits, 16 if hexadecimal else 10)
    return None if number > 0x10FFFF or 0xD800 <= number <= 0xDFFF else number


def _decode(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1][0] != "#":
            return ENTITIES.get(m[1].lower(), m[0])
        number = _code_point(m[1])
        return m[0] if number is None else chr(number)

    return _ENTITY.sub(one, text)


@F.pandas_udf(StringType())
def _decode_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else _decode(s))


def decode_html(c: Column) -> Column:
    """Entities decoded once, so &amp;lt; becomes &lt;. Unknown ones, surrogates and numbers beyond Unicode stay as they are."""
    has = c.contains("&")
    return F.when(has, _decode_batch(F.when(has, c))).otherwise(c)


#: Elements that go with their contents, and tags that end a line.
UNSEEN = ("script", "style")
LINE_ENDS = (r"<br\s*/?>", "</p>", "</div>", "</tr>", "</li>")


def untagged(c: Column) -> Column:
    """Tags to white space; script and style with their contents."""
    for name in UNSEEN:
        c = F.regexp_replace(c, rf"(?is)<{name}\b[^>]*>.*?</{name}>", " ")
    c = F.regexp_replace(c, "(?i)" + "|".join(LINE_ENDS), "\n")
    return F.regexp_replace(c, "<[^>]+>", " ")


def strip_html(c: Column) -> Column:
    return normalize_name(decode_html(untagged(c)))


def _element(tag: str) -> str:
    """An element by its local name, any prefix before it; the group is its content."""
    name = rf"(?:\w+:)?{tag}"
    return rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>"


def xml_value(c: Column, tag: str) -> Column:
    """Text of the first element of that name, of a value element inside it if there is one; null without the element."""
    body = F.regexp_extract(c, _element(tag), 1)
    inner = F.when(body.rlike(_element("value")), F.regexp_extract(body, _element("value"), 1)).otherwise(body)
    return F.when(c.rlike(_element(tag)), normalize_name(decode_html(F.regexp_replace(inner, "<[^>]+>", " "))))


def xml_blocks(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(c, F.lit(_element(tag)), 1)


def as_number(c: Column) -> Column:
    """A number out of text: commas and other marks dropped. Text without digits, point or sign is 0; no text is null."""
    kept = F.regexp_replace(c, "[^0-9.+-]", "")
    return F.when(c.isNull() | (c == ""), None).when(kept == "", 0.0).when(kept.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), kept.try_cast("double"))


def as_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)).isin("true", "1"), F.lit(False))


def parse_participants(c: Column) -> Column:
    """'entity:role|...' split at each token's last colon; a token without one loses its last character as the entity."""
    tokens = F.filter(F.split(c, "\\|"), lambda x: x != "")

    def one(t: Column) -> Column:
        colon = t.contains(":")
        entity = F.when(colon, F.regexp_extract(t, "(?s)^(.*):([^:]*)$", 1)).otherwise(F.substring(t, F.lit(1), F.length(t) - 1))
        return F.struct(entity.alias("entity_id"), F.when(colon, F.regexp_extract(t, "(?s)^(.*):([^:]*)$", 2)).otherwise(t).alias("role"))

    return F.transform(tokens, one)


def edge_start(valid_from: Column, observed_at: Column) -> Column:
    return F.coalesce(valid_from, F.substring(observed_at, 1, 10))


def edge_in_date_range(valid_from: Column, valid_to: Column, observed_at: Column, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Overlap by string order; an edge without an end is a point, and a missing bound passes."""
    start = edge_start(valid_from, observed_at)
    end, ok = F.coalesce(valid_to, start), F.lit(True)
    if date_from:
        ok = ok & ~F.coalesce(end < date_from, F.lit(False))
    if date_to:
        ok = ok & ~F.coalesce(start > date_to, F.lit(False))
    return ok


def identifier_list(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat_ws(":", F.coalesce(i["scheme"], F.lit("")), F.coalesce(i["value"], F.lit("")))), "|")


def candidate_key(run_id: Column, seq: Column, key: Column, agent: Column, entity_type: Column, name: Column, ids: Column) -> Column:
    """The given key, else agent:type:(name or identifiers); a person without identifiers gets a key of their own."""
    lonely = (entity_type == "PERSON") & (F.coalesce(F.size(ids), F.lit(0)) <= 0)
    own = F.concat_ws(":", agent, F.lit("PERSON:unresolved"), stable_id("unresolved", run_id, seq))
    return F.coalesce(key, F.when(lonely, own).otherwise(F.concat_ws(":", agent, entity_type, F.coalesce(name, identifier_list(ids)))))


def parse_json_map(c: Column) -> Column:
    """Attributes of JSON text; {} where it is not an object."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.expr("map()").cast("map<string,string>"))
