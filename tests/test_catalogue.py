"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from vantage.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET memory_limit = '4GB'; SET max_temp_directory_size = '1GB'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(float(value), 6) + 0.0 if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = canonical(df.columns, df.collect())
    assert got[1]
    if sql := catalogue.oracle_sql().get(name):
        relation = duck.sql(sql)
        want = canonical(relation.columns, relation.fetchall())
        assert got[0] == want[0] and len(got[1]) == len(want[1])
        assert got[1] == want[1]
