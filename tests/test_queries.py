"""Every query against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from querna import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (decimal.Decimal, int, float)) and not isinstance(v, bool):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    if name in catalogue.oracle_sql():
        r = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(df.columns) == sorted(r.columns)
        assert sorted((plain(tuple(x[c] for c in r.columns)) for x in rows), key=repr) == sorted(map(plain, r.fetchall()), key=repr)


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
