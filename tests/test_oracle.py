"""Every registered query equals its SQL."""

import math

import duckdb
import pytest
from evalspark.plans import records, records_sql  # noqa: F401
from evalspark.plans.oracle import SQL
from evalspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
