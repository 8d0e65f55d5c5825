"""Every registered query runs on the smallest set, and agrees with its SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievework.plans import bindings, editorial, elementary, layers  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "match_id", "kind", "similarity"]


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, con, name):
    df = bindings.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in bindings.ORACLES:
        r = con.sql(bindings.ORACLES[name])
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
