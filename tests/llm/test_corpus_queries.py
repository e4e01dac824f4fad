"""The registered corpus queries that SQL can express, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from attestry.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr([round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as from read_parquet('{path}')")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert plain(got) == plain(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact dedup", "near dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == columns
        left = {r.doc_id for r in kept.select("doc_id").collect()}
        assert left <= {r.doc_id for r in docs.select("doc_id").collect()} and left
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    good = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 0").join(docs, "doc_id").count()
    assert good <= 2
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, FOLDER)
    assert mixed.columns == columns
    pieces = corpus_pipeline.STAGES[4][1](spark, mixed, FOLDER)
    assert pieces.agg({"length": "max"}).first()[0] <= 2048


def test_pipeline_runs_as_a_whole(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.agg({"length": "max"}).first()[0] <= 2048 and pieces.select("doc_id").distinct().count() > 100
