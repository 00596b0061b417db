"""Collects the queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def plain(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The chosen columns, timestamps as epoch seconds so that no time zone matters."""
    chosen = df.select(*columns) if columns else df
    return chosen.select(
        *[
            F.unix_timestamp(f.name).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name)
            for f in chosen.schema.fields
        ]
    )
