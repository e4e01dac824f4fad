import math

from pyspark.sql import functions as F

from attestry.functions import columns as C
from attestry.functions.vocabulary import CAREER_PREDICATES, VOCABULARY, classify_predicates


def values(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, c string").orderBy("k").select(expression(F.col("c"))).collect()]


def test_stable_id(spark):
    assert values(spark, ["LEI:X"], lambda c: C.stable_id("entity", c)) == ["43a94597-d391-5033-adc0-98cb7dbb30a9"]


def test_names(spark):
    rows = ["  A &amp;\t B  ", "ﬁrm　﻿x", None, "", "ＡＢ"]
    assert values(spark, rows, C.normalize_name) == ["A & B", "firm x", None, "", "AB"]
    assert values(spark, ["Smith &AMP; Sons, Inc."], C.company_slug) == ["smith-and-sons-inc"]


def test_registry_numbers(spark):
    assert values(spark, ["CIK 12", "none", "12345678901", None], C.normalize_cik) == ["0000000012", None, None, None]
    assert values(spark, ["0000320193-24-000001", "1"], C.normalize_accession) == ["0000320193-24-000001", None]
    assert values(spark, ["000032019324000001"], C.accession_filer_cik) == ["320193"]


def test_html_is_decoded_once(spark):
    rows = ["&amp;lt;", "&#65;&#x42;&nbsp;&unknown;", "&#x110000;", "a & b", None, "&AMP;&mdash;"]
    assert values(spark, rows, C.decode_html) == ["&lt;", "AB &unknown;", "&#x110000;", "a & b", None, "&—"]
    assert values(spark, ["<p>a</p><script>x<y</script><b>b</b>&amp;c<br/>d"], C.strip_html) == ["a b &c d"]


def test_xml(spark):
    text = "<n:a x='1'><value> 5 &amp; 6 </value></n:a><b></b>"
    assert values(spark, [text, "<c/>"], lambda c: C.xml_value(c, "a")) == ["5 & 6", None]
    assert values(spark, [text], lambda c: C.xml_value(c, "b")) == [""]


def test_lenient_numbers_and_flags(spark):
    rows = ["$1,234.5", "1-2", "n/a", "", None, "1e5", "(7)", ".", "+-", "-3"]
    assert values(spark, rows, C.as_number) == [1234.5, None, 0.0, None, None, 15.0, 7.0, None, None, -3.0]
    assert values(spark, [" TRUE", "1", "yes", None], C.as_boolean) == [True, True, False, False]


def test_participants(spark):
    got = values(spark, ["a:b:ROLE|x:Y||lone"], C.parse_participants)[0]
    assert [(p.entity_id, p.role) for p in got] == [("a:b", "ROLE"), ("x", "Y"), ("lon", "lone")]


def test_open_edges_are_points(spark):
    rows = [("2018-01-01", None, None), ("2016-01-01", "2019-01-01", None), (None, None, None), (None, None, "2020-05-05T00:00:00Z")]
    df = spark.createDataFrame(rows, "f string, t string, o string")
    got = [r[0] for r in df.select(C.edge_in_date_range(F.col("f"), F.col("t"), F.col("o"), "2018-06-01", "2020-12-31")).collect()]
    assert got == [False, True, True, True]


def test_vocabulary(spark):
    assert len(VOCABULARY) == 40 and "DIRECTOR_OF" in CAREER_PREDICATES and "PARENT_OF" not in CAREER_PREDICATES
    got = {r.predicate: (r.category, r.inverse, r.temporal) for r in classify_predicates(spark.createDataFrame([("PARENT_OF",), ("BACKED",)], "predicate string")).collect()}
    assert got == {"PARENT_OF": ("CORPORATE", "SUBSIDIARY_OF", True), "BACKED": ("CONTEXTUAL", None, True)}


def test_nan_is_not_a_number(spark):
    from attestry.operators.validate import validate_resolved_relationships

    row = ("s", "e", "a", "b", 0.5, 1.0, math.nan, math.nan, "P")
    df = spark.createDataFrame([row], "source_document_id string, evidence string, subject_id string, object_id string, confidence double, resolution_confidence double, percentage double, shares double, predicate string")
    assert validate_resolved_relationships(df).first().reasons == []
