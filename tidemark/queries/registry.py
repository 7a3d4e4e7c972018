"""Registered queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


table = read_table


def days_after(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


def doc_date(doc_id: Column) -> Column:
    """Fixed test rule: a publication date for each document."""
    return days_after("2000-01-01", (doc_id * 37) % 3650)


def query_date(item_id: Column) -> Column:
    """Fixed test rule: an as-of date for each benchmark passage."""
    return days_after("2000-01-01", (item_id * 91) % 3650)


DOC_DATE_SQL = "CAST(DATE '2000-01-01' + CAST((doc_id * 37) % 3650 AS INT) AS DATE)"
QUERY_DATE_SQL = "CAST(DATE '2000-01-01' + CAST((item_id * 91) % 3650 AS INT) AS DATE)"
