"""Joins of a large table against a lookup whose size is not known beforehand.

The lookup is computed once and written to the work folder. Spark then knows its size in
bytes: below ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the large side stays
in place; beyond, both sides meet in a shuffle join, whose skewed partitions adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilscan.session import materialise


def lookup_join(large: DataFrame, lookup: DataFrame, keys: list[str], how: str, stored: bool = False) -> DataFrame:
    """``large`` joined with ``lookup`` on equal keys: inner, left, left_semi or left_anti.
    ``lookup`` must be unique per key for inner and left joins; ``stored`` says that it is a
    table as it lies on disk, or made of literals, and need not be written."""
    if not (stored or lookup.isStreaming):
        lookup = materialise(lookup, "lookup")
    return large.join(lookup, keys, how)


def keep_known(large: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    return lookup_join(large, lookup.select(*keys).distinct(), keys, "left_semi")


def keep_unknown(large: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    return lookup_join(large, lookup.select(*keys).distinct(), keys, "left_anti")
