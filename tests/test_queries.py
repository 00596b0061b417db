"""Every registered query runs on the smallest tables and has its SQL."""

import pytest

from catalog.registry import ORACLES, QUERIES
from __spark_entry__ import entry, oracle_sql, queries
from tools_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"

SAMPLE = (
    "scan_gate_verdicts", "scan_planted_all_detectors", "detect_phone", "policy_gate", "triage", "detect_phrases",
    "stream_alert_stale_repo", "source_links", "plugin_detector", "lookback_counts", "scan_history_blobs",
)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    frame = queries()[name](spark, SF)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cur = duck.execute(oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
