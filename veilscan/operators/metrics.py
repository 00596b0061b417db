"""Gauges, rates and alerts over findings, scan records and detector runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilscan.functions import text
from veilscan.operators.lookups import lookup_join

# Events are combined per minute before any window runs over them.
BUCKET_S = 60

# Quantiles are off by at most one in this many ranks.
QUANTILE_ACCURACY = 50_000


def open_findings_metric(store: DataFrame) -> DataFrame:
    return (
        store.filter(F.col("triage_status") == "OPEN")
        .groupBy("repo_id", "severity", "detector_id")
        .agg(F.count("*").alias("value"))
    )


def scans_by_status(records: DataFrame) -> DataFrame:
    return records.groupBy("repo_id", "status").agg(F.count("*").alias("scans"))


def scan_durations(records: DataFrame) -> DataFrame:
    """p50 and p95 per repository, from a sketch that is combined map-side and stays
    small however many scans a repository has."""
    return records.groupBy("repo_id").agg(
        F.percentile_approx("duration_s", F.lit(0.5), F.lit(QUANTILE_ACCURACY)).alias("p50"),
        F.percentile_approx("duration_s", F.lit(0.95), F.lit(QUANTILE_ACCURACY)).alias("p95"),
    )


def detector_health(runs: DataFrame) -> DataFrame:
    return runs.groupBy("detector_id").agg(
        F.count("*").alias("runs"),
        F.percentile_approx("duration_s", F.lit(0.95), F.lit(QUANTILE_ACCURACY)).alias("p95"),
        F.avg(F.col("failed").cast("double")).alias("error_rate"),
    )


def active_detectors(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_distinct("detector_id").alias("detectors"))


def coverage(repos: DataFrame, records: DataFrame, gates: DataFrame, now: Column) -> DataFrame:
    """Share of repositories ever scanned, how many fail the gate, and the longest
    time since a last scan in seconds."""
    last = records.groupBy("repo_id").agg(F.max("started_at").alias("last_at"))
    base = repos.select(F.col("name").alias("repo_id"))
    joined = lookup_join(base, last, ["repo_id"], "left")
    joined = lookup_join(joined, gates.select("repo_id", "passed"), ["repo_id"], "left")
    return joined.agg(
        F.count("*").alias("repos"),
        F.count_if(F.col("last_at").isNotNull()).alias("scanned"),
        (F.count_if(F.col("last_at").isNotNull()) / F.count("*")).alias("share_scanned"),
        F.count_if(~F.col("passed")).alias("gate_fail"),
        F.max(F.unix_timestamp(now) - F.unix_timestamp("last_at")).alias("longest_gap_s"),
    )


def scan_progress(completions: DataFrame) -> DataFrame:
    """10 + round(85 · done / total) per scan over its repositories' completion rows."""
    share = 85.0 * F.count_if("done") / F.greatest(F.count("*"), F.lit(1))
    return completions.groupBy("scan_id").agg(
        (F.floor(share + 0.5) + 10).cast("int").alias("progress")
    )


# Weight of a finding by severity, INFO to CRITICAL.
RISK_WEIGHTS = (0, 1, 3, 7, 10)


def top_repos_by_risk(store: DataFrame, limit: int = 10) -> DataFrame:
    weights = F.array(*[F.lit(w) for w in RISK_WEIGHTS])
    weight = F.element_at(weights, text.severity_rank(F.col("severity")) + 1)
    return (
        store.filter(F.col("triage_status") == "OPEN")
        .groupBy("repo_id")
        .agg(F.sum(weight).cast("bigint").alias("risk"), F.count("*").alias("open_findings"))
        .orderBy(F.col("risk").desc(), "repo_id")
        .limit(limit)
    )


def gate_fail_quota(gates: DataFrame) -> DataFrame:
    return gates.agg(
        F.count("*").alias("repos"),
        F.count_if(~F.col("passed")).alias("failing"),
        (F.count_if(~F.col("passed")) / F.count("*")).alias("quota"),
    )


def utc_day(ts: Column) -> Column:
    """The UTC day as text, whatever the session's time zone."""
    days = F.floor(F.unix_timestamp(ts) / 86400).cast("int")
    return F.date_from_unix_date(days).cast("string")


def finding_trend(findings: DataFrame) -> DataFrame:
    """New findings per day and severity."""
    return findings.groupBy(
        utc_day(F.col("first_seen")).alias("day"), "severity"
    ).agg(F.count("*").alias("new_findings"))


def remediation_metrics(actions: DataFrame) -> DataFrame:
    return actions.groupBy(
        utc_day(F.col("at")).alias("day"), "type", "result"
    ).agg(F.count("*").alias("actions"))


def window_counts(
    events: DataFrame, ts: str, width: str, slide: str, *keys: str, value: Column | None = None
) -> DataFrame:
    """Events per key in sliding windows: the batch form of the streaming alerts."""
    amount = F.count("*") if value is None else F.sum(value)
    return (
        events.groupBy(F.window(ts, width, slide).alias("w"), *keys)
        .agg(amount.cast("bigint").alias("n"))
        .select(F.col("w.start").alias("window_start"), *keys, "n")
    )


def alert_new_critical(findings: DataFrame, ts: str = "ts") -> DataFrame:
    """Windows of 15 minutes with a new critical finding. All findings are counted
    through, so that in a stream the others move the watermark on as well."""
    critical = F.when(F.col("severity") == "CRITICAL", 1).otherwise(0)
    return window_counts(findings, ts, "15 minutes", "5 minutes", value=critical).filter("n > 0")


def alert_gate_fail(gates: DataFrame, ts: str = "ts") -> DataFrame:
    """Windows of five minutes in which a repository's gate was red throughout."""
    return (
        gates.groupBy(F.window(ts, "5 minutes").alias("w"), "repo_id")
        .agg(F.min("gate").alias("red"))
        .filter("red = 1")
        .select(F.col("w.start").alias("window_start"), "repo_id")
    )


def alert_error_rate(runs: DataFrame, ts: str = "ts", per_second: float = 0.1) -> DataFrame:
    """15-minute windows in which a detector fails more often than allowed."""
    failed = F.col("failed").cast("int")
    counted = window_counts(runs, ts, "15 minutes", "5 minutes", "detector_id", value=failed)
    return counted.withColumn("rate", F.col("n") / F.lit(900.0)).filter(F.col("rate") > per_second)


def alert_stale_repo(records: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Repositories whose last scan is longer ago than the limit."""
    last = records.groupBy("repo_id").agg(F.max("started_at").alias("last_at"))
    return last.filter(F.col("last_at") < now - F.make_dt_interval(F.lit(days)))


def scan_rate_per_repo(records: DataFrame, ts: str = "started_at") -> DataFrame:
    counted = window_counts(records, ts, "1 hour", "15 minutes", "repo_id")
    return counted.withColumn("per_second", F.col("n") / F.lit(3600.0))


def scan_sessions(records: DataFrame, ts: str = "started_at", gap_s: int = 1800) -> DataFrame:
    """Runs of activity per repository with their last status.

    Events are first combined per minute (a minute never spans two sessions), minutes within
    each day, and the runs of the days within the repository: no window holds more than a day's
    minutes or a repository's sessions.
    """
    at = F.col(ts)
    minutes = records.groupBy(
        "repo_id", F.floor(F.unix_timestamp(at) / BUCKET_S).alias("minute")
    ).agg(
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.count("*").alias("c"),
        F.max(F.struct(at.alias("at"), F.col("id"), F.col("status"))).alias("latest"),
    )
    gap = F.make_dt_interval(secs=F.lit(gap_s))
    daily = minutes.withColumn("day", F.floor(F.unix_timestamp("first") / 86400)).drop("minute")
    runs = _joined(_joined(daily, gap, "repo_id", "day").drop("day"), gap, "repo_id")
    return runs.select(
        F.col("first").alias("session_start"), (F.col("last") + gap).alias("session_end"), "repo_id",
        F.col("c").alias("n"), F.col("latest.status").alias("last_status"),
    )


def _joined(spans: DataFrame, gap: Column, *keys: str) -> DataFrame:
    """Spans (first, last, c, latest) of a key joined where no more than the gap lies between."""
    order = Window.partitionBy(*keys).orderBy("first")
    previous = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(previous.isNull() | (F.col("first") > previous + gap), 1).otherwise(0)
    numbered = spans.withColumn("opens", opens).withColumn("session", F.sum("opens").over(order))
    return numbered.groupBy(*keys, "session").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("c").alias("c"), F.max("latest").alias("latest")
    ).drop("session")


def lookback_counts(events: DataFrame, ts: str, seconds: int, *keys: str) -> DataFrame:
    """Events of the last ``seconds`` at every minute in which a key has any: the
    counter increase an alert rule looks at. Events are first counted per minute, so
    the window runs over minutes, not events; a key's minutes are further split into
    day-long stretches, each with the minutes just before it, so that no single task
    has to hold one key's whole history."""
    stretch = max(86400, seconds)
    minute = F.floor(F.unix_timestamp(ts) / BUCKET_S) * BUCKET_S
    per_minute = events.groupBy(*keys, minute.alias("minute")).agg(F.count("*").alias("c"))
    home = F.floor(F.col("minute") / stretch)
    also = F.floor((F.col("minute") + seconds) / stretch)
    placed = per_minute.withColumn("stretch", F.explode(F.array_distinct(F.array(home, also))))
    w = Window.partitionBy(*keys, "stretch").orderBy("minute").rangeBetween(-(seconds - 1), 0)
    return (
        placed.withColumn("n", F.sum("c").over(w))
        .filter(F.col("stretch") == home)
        .select(*keys, "minute", "n")
    )
