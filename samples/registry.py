"""Where the sample queries sign up."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rigbook.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL definition if it has one."""
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = lambda spark, sf_dir: function(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[key] = sql
        return function
    return add
