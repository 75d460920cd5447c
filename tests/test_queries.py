from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from passagework.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else tuple(v) if isinstance(v, list) else v
    return sorted(columns), sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in catalog.ORACLE_SQL:
        con = duck.execute(catalog.ORACLE_SQL[name])
        assert got == rows([d[0] for d in con.description], con.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "chunk_idx", "chunk"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
