"""Streaming queries, run over all available files; the batch SQL checks them.

A window is emitted once the watermark, ten minutes behind the latest event, has
passed its end; the SQL has the same condition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common, sql
from catalog.registry import plain, query
from catalog.reporting import SESSIONS_SQL, sliding
from catalog.sources import _FEED, feed_of
from veilscan.operators.detect import detect
from veilscan.session import work_dir
from veilscan.sources import corpora, store as st
from veilscan.streaming import alerts, findings as sf

q = sql.with_query


def _planted_stream(spark, sf_dir):
    return corpora.planted_units_of(corpora.stream_table(spark, sf_dir, "documents"))


_PLANTED_RAW = sql.findings_ctes(sql.PLANTED, common.CONFIG)


@query("stream_scan", q(_PLANTED_RAW, f"SELECT {sql.RAW_COLUMNS} FROM raw"))
def stream_scan(spark, sf_dir):
    """Every unit is delivered twice; it counts once."""
    units = _planted_stream(spark, sf_dir)
    twice = units.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    path = work_dir(spark, "stream-scan")
    sf.stream_scan(twice, common.CONFIG, path, work_dir(spark, "stream-scan-state")).awaitTermination()
    return plain(spark.read.parquet(path).drop("batch_id"))


@query("stream_dedup_findings", q(
    common.AGG, "SELECT repo_id, fingerprint, rule_id, commit_id, first_seen, last_seen, occurrences FROM agg",
))
def stream_dedup_findings(spark, sf_dir):
    units = corpora.history_units(_planted_stream(spark, sf_dir))
    path = work_dir(spark, "dedup")
    sf.stream_dedup(units, common.CONFIG, path, work_dir(spark, "dedup-state")).awaitTermination()
    combined = sf.combine_partials(spark.read.parquet(path))
    return plain(combined, "repo_id", "fingerprint", "rule_id", "commit_id", "first_seen", "last_seen", "occurrences")


@query("stream_ingest_ci", q(
    _FEED,
    "SELECT sha256('run/run-' || user_id) AS scan_id, 'repo' || (user_id % 20) AS repo_id, 3::INTEGER AS finding_count, 'run-' || user_id AS run_ref FROM latest",
))
def stream_ingest_ci(spark, sf_dir):
    feed = feed_of(corpora.stream_table(spark, sf_dir, "events"))
    path = work_dir(spark, "ingest")
    sf.start_ingest(feed, F.col("body"), path, work_dir(spark, "ingest-state")).awaitTermination()
    records = st.ingested_records(st.ingested_runs(spark, path))
    return records.select("scan_id", "repo_id", "finding_count", "ci.run_ref")


_CLOSED = "(SELECT max(t) - 600 FROM src)"


@query("stream_alert_new_critical", q(
    f"{_PLANTED_RAW}, src AS (SELECT ts AS t FROM units), "
    f"crit AS (SELECT ts AS t FROM raw WHERE severity = 'CRITICAL'), w AS (SELECT {sliding(900, 300)} FROM crit)",
    f"SELECT window_start, count(*) AS n FROM w WHERE window_start + 900 <= {_CLOSED} GROUP BY window_start",
))
def stream_alert_new_critical(spark, sf_dir):
    units = _planted_stream(spark, sf_dir).withWatermark("ts", sf.LATENESS)
    return plain(sf.run_to_table(alerts.alert_new_critical(detect(units, common.CONFIG)), "critical"))


def _stream_records(spark, sf_dir):
    return corpora.scan_records_of(corpora.stream_table(spark, sf_dir, "events"))


_SRC = "src AS (SELECT started_at AS t FROM records)"


@query("stream_alert_gate_fail", q(
    f"{common.SCAN_RECORDS}, {_SRC}",
    f"SELECT window_start, repo_id FROM (SELECT started_at - started_at % 300 AS window_start, repo_id, min((status IN ('FAILED','CANCELLED','RUNNING'))::INT) AS red FROM records GROUP BY ALL) WHERE red = 1 AND window_start + 300 <= {_CLOSED}",
))
def stream_alert_gate_fail(spark, sf_dir):
    red = F.col("status").isin("FAILED", "CANCELLED", "RUNNING").cast("int")
    gates = _stream_records(spark, sf_dir).select("repo_id", F.col("started_at").alias("ts"), red.alias("gate"))
    return plain(sf.run_to_table(alerts.alert_gate_fail(gates), "gate-fail"))


@query("stream_alert_error_rate", q(
    f"{common.DETECTOR_RUNS}, src AS (SELECT ts AS t FROM runs)",
    f"SELECT window_start, detector_id, count(*) AS n, round(count(*) / 900.0, 9) AS rate FROM (SELECT detector_id, {sliding(900, 300)} FROM (SELECT detector_id, ts AS t FROM runs WHERE failed)) WHERE window_start + 900 <= {_CLOSED} GROUP BY ALL HAVING count(*) / 900.0 > 0.002",
))
def stream_alert_error_rate(spark, sf_dir):
    runs = corpora.detector_runs_of(corpora.stream_table(spark, sf_dir, "events"))
    found = sf.run_to_table(alerts.alert_error_rate(runs, per_second=0.002), "error-rate")
    return plain(found.withColumn("rate", F.round("rate", 9)))


@query("stream_scan_rate", q(
    f"{common.SCAN_RECORDS}, {_SRC}",
    f"SELECT window_start, repo_id, count(*) AS n FROM (SELECT repo_id, {sliding(3600, 900)} FROM (SELECT repo_id, started_at AS t FROM records)) WHERE window_start + 3600 <= {_CLOSED} GROUP BY ALL",
))
def stream_scan_rate(spark, sf_dir):
    rates = sf.run_to_table(alerts.scan_rate_per_repo(_stream_records(spark, sf_dir)), "scan-rate")
    return plain(rates, "window_start", "repo_id", "n")


@query("stream_scan_sessions", q(
    f"{common.SCAN_RECORDS}, {_SRC}, {SESSIONS_SQL}",
    f"SELECT min(started_at) AS session_start, max(started_at) + 1800 AS session_end, repo_id, count(*) AS n, arg_max(status, {{'a': started_at, 'b': id}}) AS last_status FROM numbered GROUP BY repo_id, session HAVING max(started_at) + 1800 <= {_CLOSED}",
))
def stream_scan_sessions(spark, sf_dir):
    return plain(sf.run_to_table(alerts.scan_sessions(_stream_records(spark, sf_dir)), "sessions"))


@query("stream_alert_stale_repo", q(
    f"{common.SCAN_RECORDS}, src AS (SELECT started_at AS t FROM records WHERE status = 'COMPLETED'), "
    "gaps AS (SELECT repo_id, started_at AS last_at, lead(started_at) OVER (PARTITION BY repo_id ORDER BY started_at) AS next_at FROM records WHERE status = 'COMPLETED')",
    f"SELECT repo_id, last_at, last_at + 43200 AS stale_since FROM gaps WHERE coalesce(next_at - last_at > 43200, true) AND last_at + 43200 <= {_CLOSED}",
))
def stream_alert_stale_repo(spark, sf_dir):
    """Repositories without a completed scan for half a day."""
    completed = _stream_records(spark, sf_dir).filter("status = 'COMPLETED'")
    return plain(sf.run_to_table(alerts.alert_stale_repo(completed, "12 hours"), "stale"))
