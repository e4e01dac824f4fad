"""Every registered graph query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from attestry.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as from read_parquet('{path}')")
    return con


def plain(rows):
    def one(x):
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(repr([one(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    if name in ORACLE_SQL:
        want = tables.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert plain(rows) == plain(want)
