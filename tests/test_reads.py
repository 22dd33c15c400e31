"""Queries whose job could be done without rows: Spark reads the columns they tell of."""

import pytest

from millrace.plans import catalogue
from millrace.sources import tables as src


def scans(df) -> str:
    return " ".join(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x)


@pytest.mark.parametrize(("name", "columns"), [("required_columns", ["o_orderkey", "o_custkey"]), ("table_concat", ["n_name", "r_name", "s_name"])])
def test_columns_are_read(spark, sf, name, columns):
    read = scans(catalogue.queries()[name](spark, sf))
    assert all(c in read for c in columns)


def test_present_and_rows(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, `b.c` string")
    want = [("a", True), ("b.c", True), ("A", False), ("d", False)]
    names = [w for w, _ in want]
    assert [tuple(r) for r in src.present(df, names).collect()] == want
    assert [tuple(r) for r in src.present(df.where("false"), names).collect()] == want
    with pytest.raises(ValueError):
        src.require(df, ["a", "d"])
    assert {tuple(r) for r in src.rows_of(df.selectExpr("'x' as o", "a"), "o", "a").collect()} == {("x", 2)}
