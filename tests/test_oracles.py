"""Every catalogue query against DuckDB on the smallest tables; queries without SQL must run."""

import math

import duckdb
import pytest

from millrace.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(cols, data):
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
            return "nan" if math.isnan(v) else f"{float(v):.6g}"
        return str(v)

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(one(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf, name):
    df = catalogue.queries()[name](spark, sf)
    got = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
