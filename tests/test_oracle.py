"""Every registered query of the engine against its SQL at the smallest scale."""

import math

import duckdb
import pytest

from sylvarank import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, DATA)
    rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if name not in catalog.ORACLE:
        assert rows
        return
    want = sql.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows == rows_of(want.columns, want.fetchall())
