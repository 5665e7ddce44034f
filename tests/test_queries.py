"""Every registered query against its SQL, on the smallest tables."""

import collections
import datetime as dt
import glob
import math
import os

import duckdb
import pytest

from noticeworks import catalogue

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, int | float):
        return None if math.isnan(x) else round(float(x), 6)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    out = catalogue.QUERIES[name](spark, TABLES)
    columns = sorted(out.columns)
    got = collections.Counter(tuple(plain(x) for x in r) for r in out.select(*columns).collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    want = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert got == collections.Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
