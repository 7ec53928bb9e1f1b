"""Names of the runnable queries, what they compute and the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from closebook.sources.fixtures import Tables, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with its SQL twin."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def money(column) -> Column:
    """Decimal amount with two places, as double for output."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("decimal(38,2)").cast("double")


def moment(column) -> Column:
    """Timestamp as text for output."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def big(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint")
