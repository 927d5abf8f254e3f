"""Every query gives the rows of its SQL in DuckDB, and some rows at all."""

import glob
import os

import duckdb
import pytest

from paragram import catalog


def plain(v):
    return "nan" if v != v else repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert want and sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark, sf):
    assert catalog.entry(spark, sf).columns == ["src", "tgt", "confidence", "src_len", "tgt_len", "ratio"]
