"""Registration of queries: a name, a function of (spark, sf_dir), and SQL that says the same, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import load, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Tables of texts, whose rows are much work each.
TEXTS = {"documents", "pages"}


class Tables:
    """tables.documents and so on, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = load(self.spark, self.sf_dir, name)
        return spread(df) if name in TEXTS else df


def query(sql: str | None = None):
    """Registers f(tables) under its own name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
