"""Alerts and rates as streaming queries. Rows later than the watermark are dropped.

Started in update mode an alert fires with the batch that causes it; in append mode it is
written once, when its window has closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilscan.operators import metrics as mo
from veilscan.streaming.findings import LATENESS


def alert_new_critical(findings: DataFrame, on_arrival: bool = False) -> DataFrame:
    """``findings`` come from units with a watermark on ``ts``, so that units without
    findings move it on too. With ``on_arrival`` the time at which a finding is made counts
    instead of that of its commit: an old commit that is scanned today alerts today."""
    if not on_arrival:
        return mo.alert_new_critical(findings)
    arrived = findings.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", LATENESS)
    return mo.alert_new_critical(arrived, "arrived")


def alert_gate_fail(gates: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return mo.alert_gate_fail(gates.withWatermark("ts", lateness))


def alert_error_rate(runs: DataFrame, per_second: float = 0.1, lateness: str = LATENESS) -> DataFrame:
    return mo.alert_error_rate(runs.withWatermark("ts", lateness), per_second=per_second)


def scan_rate_per_repo(records: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return mo.scan_rate_per_repo(records.withWatermark("started_at", lateness))


def scan_sessions(records: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Activity per repository up to a gap, with the last status."""
    return (
        records.withWatermark("started_at", lateness)
        .groupBy(F.session_window("started_at", gap).alias("w"), "repo_id")
        .agg(F.count("*").alias("n"), F.max(F.struct("started_at", "id", "status")).alias("latest"))
        .select(
            F.col("w.start").alias("session_start"),
            F.col("w.end").alias("session_end"),
            "repo_id",
            "n",
            F.col("latest.status").alias("last_status"),
        )
    )


def alert_stale_repo(records: DataFrame, limit: str = "30 days", lateness: str = LATENESS) -> DataFrame:
    """Repositories that go without a scan for longer than the limit.

    A session with the limit as its gap closes exactly when a repository has been
    quiet for that long, so the closing of a session is the alert.
    """
    quiet = F.session_window("started_at", limit)
    return (
        records.withWatermark("started_at", lateness)
        .groupBy(quiet.alias("w"), "repo_id")
        .agg(F.max("started_at").alias("last_at"))
        .select("repo_id", "last_at", F.col("w.end").alias("stale_since"))
    )
