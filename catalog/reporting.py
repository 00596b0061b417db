"""Queries for finding lists, reports, dashboards, metrics and batch alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common, sql
from catalog.registry import plain, query
from veilscan.functions import fixed_values as fv, text
from veilscan.operators import govern, metrics as mo, query as qo, sketches
from veilscan.operators.lookups import lookup_join
from veilscan.session import materialise, work_dir
from veilscan.sources import corpora, reports as rp, store as st

q = sql.with_query

def _stored(spark, sf_dir):
    return common.store(spark, sf_dir)


# --- lists --------------------------------------------------------------------------

@query("query_findings", q(
    common.STORE,
    "SELECT id, severity, rule_id FROM store WHERE triage_status = 'OPEN' AND detector_id = 'secret.regex-ruleset' AND severity_rank >= 2 ORDER BY severity_rank DESC, id LIMIT 40 OFFSET 10",
))
def query_findings(spark, sf_dir):
    page = qo.query_findings(
        _stored(spark, sf_dir), min_severity="MEDIUM", detector_id=fv.SECRET_RULES_DETECTOR, status="OPEN", offset=10, limit=40
    )
    return page.select("id", "severity", "rule_id")


@query("facet_query", q(
    common.STORE,
    "SELECT id, path FROM store WHERE triage_status <> 'OPEN' AND severity = 'HIGH' AND path LIKE '%.md'",
))
def facet_query(spark, sf_dir):
    return qo.facet_query(_stored(spark, sf_dir), "is:closed severity:high language:md").select("id", "path")


@query("facet_values", q(
    common.STORE,
    "SELECT DISTINCT 'detector' AS facet, detector_id AS value FROM store UNION SELECT DISTINCT 'rule', rule_id FROM store UNION SELECT DISTINCT 'language', string_split(path, '.')[-1] FROM store",
))
def facet_values(spark, sf_dir):
    return qo.facet_values(_stored(spark, sf_dir))


@query("open_closed_counts", q(
    common.STORE, "SELECT count(*) FILTER (triage_status = 'OPEN') AS open, count(*) FILTER (triage_status <> 'OPEN') AS closed FROM store",
))
def open_closed_counts(spark, sf_dir):
    return qo.open_closed_counts(_stored(spark, sf_dir))


@query("dashboard_severity_counts", q(
    common.STORE,
    f"SELECT severity, (SELECT count(*) FROM store s WHERE s.severity = v.severity AND triage_status = 'OPEN') AS n FROM (SELECT unnest({sql.strings(fv.SEVERITIES)}) AS severity) v",
))
def dashboard_severity_counts(spark, sf_dir):
    return qo.dashboard_severity_counts(_stored(spark, sf_dir))


@query("counts_by_severity", q(common.STORE, "SELECT repo_id, severity, count(*) AS n FROM store GROUP BY ALL"))
def counts_by_severity(spark, sf_dir):
    return qo.counts_by_severity(_stored(spark, sf_dir), "repo_id")


@query("dominant_language", q(
    common.STORE,
    "SELECT repo_id, arg_min(ext, {'a': -n, 'b': ext}) AS language FROM (SELECT repo_id, regexp_extract(path, '\\.([^./]*)$', 1) AS ext, count(*) AS n FROM store GROUP BY ALL) WHERE ext <> '' GROUP BY repo_id",
))
def dominant_language(spark, sf_dir):
    return qo.dominant_language(_stored(spark, sf_dir))


@query("report_rows", q(
    common.STORE,
    "SELECT scan_id, row_no::INTEGER AS row_no, severity, rule_id, path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY severity_rank DESC, path, line_no, id) AS row_no FROM store) WHERE row_no <= 5",
))
def report_rows(spark, sf_dir):
    return qo.report_rows(_stored(spark, sf_dir), 5).select(
        "scan_id", "row_no", "severity", "rule_id", "path", "line_no"
    )


@query("scan_report_summary", q(
    common.STORE,
    "SELECT scan_id, count(*) AS total, count(*) FILTER (severity='CRITICAL') AS critical, count(*) FILTER (severity='HIGH') AS high, count(*) FILTER (severity='MEDIUM') AS medium, "
    "count(*) FILTER (severity='LOW') AS low, count(*) FILTER (severity='INFO') AS info, greatest(count(*) - 50, 0) AS more FROM store GROUP BY scan_id",
))
def scan_report_summary(spark, sf_dir):
    return qo.scan_report_summary(_stored(spark, sf_dir))


@query("notify_candidates", q(
    common.AGG,
    f"SELECT repo_id, {sql.strings(fv.SEVERITIES)}[max(severity_rank) + 1] AS highest_severity, count(*) AS finding_count FROM agg GROUP BY repo_id HAVING max(severity_rank) >= 4",
))
def notify_candidates(spark, sf_dir):
    return qo.notify_candidates(common.aggregated(spark, sf_dir), "CRITICAL")


@query("report_order", q(
    common.AGG, "SELECT repo_id, fingerprint, severity FROM agg ORDER BY severity_rank DESC, repo_id, fingerprint",
))
def report_order(spark, sf_dir):
    return qo.report_order(common.aggregated(spark, sf_dir)).select("repo_id", "fingerprint", "severity")


@query("sorted_findings", q(
    common.STORE, "SELECT id, last_seen FROM store ORDER BY last_seen DESC, id",
))
def sorted_findings(spark, sf_dir):
    return plain(qo.sorted_findings(_stored(spark, sf_dir), "last_seen"), "id", "last_seen")


@query("remediable", q(
    common.STORE, "SELECT id, rule_id FROM store WHERE category = 'SECRET' AND remediation_status = 'OPEN'",
))
def remediable(spark, sf_dir):
    return _stored(spark, sf_dir).filter(govern.remediable()).select("id", "rule_id")


_LINKED = (
    "linked AS (SELECT s.repo_id, path, line_no, location, n, CASE WHEN n % 2 = 0 THEN 'main' ELSE 'HEAD' END AS ref FROM store s LEFT JOIN repos ON name = s.repo_id)"
)


@query("source_links", q(
    f"{common.STORE}, {common.REPOSITORIES}, {_LINKED}",
    "SELECT repo_id, path, line_no, CASE n % 5 WHEN 0 THEN 'https://github.com/org/' || repo_id || '/blob/' || ref || '/' || path || '#L' || line_no "
    "WHEN 1 THEN 'https://bitbucket.org/team/' || repo_id || '/src/' || ref || '/' || path || '#lines-' || line_no "
    "WHEN 2 THEN 'https://gitlab.com/grp/' || repo_id || '/blob/' || ref || '/' || path || '#L' || line_no "
    "WHEN 4 THEN 'https://code.example.org/x/' || repo_id || '.git/blob/' || ref || '/' || path || '#L' || line_no END AS link FROM linked",
))
def source_links(spark, sf_dir):
    return qo.source_links(_stored(spark, sf_dir), corpora.repositories(spark, sf_dir)).select(
        "repo_id", "path", "line_no", "link"
    )


# --- report formats -----------------------------------------------------------------

_LEVEL = "CASE WHEN severity IN ('CRITICAL','HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"


@query("sarif_results", q(
    common.FLAGGED,
    "SELECT repo_id, fingerprint, to_json({'ruleId': rule_id, 'level': " + _LEVEL + ", 'message': {'text': 'Potential ' || category || ' finding: ' || redacted_match}, "
    "'locations': [{'physicalLocation': {'artifactLocation': {'uri': path}, 'region': {'startLine': line_no}}}], "
    "'partialFingerprints': {'scannerFingerprint/v1': fingerprint}})::VARCHAR AS result FROM flagged WHERE NOT suppressed",
))
def sarif_results(spark, sf_dir):
    return rp.sarif_results(common.flagged(spark, sf_dir))


@query("sarif_documents", q(
    common.FLAGGED, "SELECT repo_id, count(*)::INTEGER AS results, 23::INTEGER AS rules FROM flagged WHERE NOT suppressed GROUP BY repo_id",
))
def sarif_documents(spark, sf_dir):
    """Results and rules counted back out of the finished documents."""
    from veilscan.operators.rulesets import rule_catalog

    documents = rp.sarif_documents(common.flagged(spark, sf_dir), rp.sarif_rules(rule_catalog(spark), F.col("rule_id")))
    results = F.from_json(F.get_json_object("document", "$.runs[0].results"), "array<string>")
    rules = F.from_json(F.get_json_object("document", "$.runs[0].tool.driver.rules"), "array<string>")
    return documents.groupBy("repo_id").agg(
        F.sum(F.size(results)).cast("int").alias("results"), F.max(F.size(rules)).alias("rules")
    )


_ESC = "replace(replace(replace(replace({0}, '|', '||'), '''', '|'''), '[', '|['), ']', '|]')"


@query("build_log_messages", q(
    common.FLAGGED,
    "SELECT repo_id, fingerprint, unnest([0, 1])::INTEGER AS part, unnest(['##teamcity[inspectionType id=''' || rule_id || ''' name=''' || rule_id || ''' category=''secret-scan'' description=''Secret scan rule'']', "
    f"'##teamcity[inspection typeId=''' || rule_id || ''' message=''' || {_ESC.format(chr(39) + 'Potential ' + chr(39) + ' || category || ' + chr(39) + ': ' + chr(39) + ' || redacted_match')} || ''' file=''' || {_ESC.format('path')} || ''' line=''' || line_no || ''' SEVERITY=''' || "
    "CASE WHEN severity IN ('CRITICAL','HIGH') THEN 'ERROR' WHEN severity = 'MEDIUM' THEN 'WARNING' ELSE 'INFO' END || ''']']) AS message FROM flagged WHERE NOT suppressed",
))
def build_log_messages(spark, sf_dir):
    return rp.build_log_messages(common.flagged(spark, sf_dir))


@query("build_log_problem", q(
    common.FLAGGED,
    "SELECT '##teamcity[buildProblem description=''Secret scan: ' || count(*) || ' finding(s)'' identity=''secretScan'']' AS message FROM flagged WHERE NOT suppressed HAVING count(*) > 0",
))
def build_log_problem(spark, sf_dir):
    return rp.build_log_problem(common.flagged(spark, sf_dir))


# --- scan records -------------------------------------------------------------------

@query("recent_scans", q(
    common.SCAN_RECORDS, "SELECT id, repo_id, status, started_at FROM records ORDER BY started_at DESC, id DESC LIMIT 25",
))
def recent_scans(spark, sf_dir):
    return plain(qo.recent_scans(corpora.scan_records(spark, sf_dir), 25), "id", "repo_id", "status", "started_at")


_LAST = (
    "last AS (SELECT repo_id, max(coalesce(finished_at, started_at)) AS last_scan_at, "
    "arg_max(status, {'a': coalesce(finished_at, started_at), 'b': id}) AS last_status FROM records GROUP BY repo_id)"
)


@query("last_scans", q(f"{common.SCAN_RECORDS}, {_LAST}", "SELECT repo_id, last_scan_at, last_status FROM last"))
def last_scans(spark, sf_dir):
    return plain(qo.last_scans(corpora.scan_records(spark, sf_dir)), "repo_id", "last_scan_at", "last_status")


@query("repository_cards", q(
    f"{common.STORE}, {common.REPOSITORIES}, {common.SCAN_RECORDS}, {_LAST}, lang AS (SELECT repo_id, arg_min(ext, {{'a': -n, 'b': ext}}) AS language FROM (SELECT repo_id, regexp_extract(path, '\\.([^./]*)$', 1) AS ext, count(*) AS n FROM store GROUP BY ALL) GROUP BY repo_id)",
    "SELECT name, type, coalesce(language, '') AS language, last_scan_at, last_status FROM repos LEFT JOIN lang ON lang.repo_id = name LEFT JOIN last ON replace(last.repo_id, 'repo', 'src') = name",
))
def repository_cards(spark, sf_dir):
    records = corpora.scan_records(spark, sf_dir).withColumn("repo_id", F.regexp_replace("repo_id", "^repo", "src"))
    cards = qo.repository_cards(
        corpora.repositories(spark, sf_dir), records, _stored(spark, sf_dir)
    )
    return plain(cards, "name", "type", "language", "last_scan_at", "last_status")


@query("stale_runs", q(
    common.SCAN_RECORDS,
    f"SELECT id, repo_id FROM records WHERE status = 'RUNNING' AND (claimed_at IS NULL OR claimed_at < {corpora.EPOCH_2024 + 10 * 86400})",
))
def stale_runs(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(corpora.EPOCH_2024 + 10 * 86400 + 120))
    return qo.stale_runs(corpora.scan_records(spark, sf_dir), now).select("id", "repo_id")


@query("requeue_stale", q(
    common.SCAN_RECORDS,
    f"SELECT id, CASE WHEN stale THEN 'QUEUED' ELSE status END AS status, CASE WHEN stale THEN 0 ELSE progress END AS progress FROM (SELECT *, status = 'RUNNING' AND (claimed_at IS NULL OR claimed_at < {corpora.EPOCH_2024 + 10 * 86400}) AS stale FROM records)",
))
def requeue_stale(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(corpora.EPOCH_2024 + 10 * 86400 + 120))
    return qo.requeue_stale(corpora.scan_records(spark, sf_dir), now).select("id", "status", "progress")


# --- metrics ------------------------------------------------------------------------

@query("open_findings_metric", q(
    common.STORE, "SELECT repo_id, severity, detector_id, count(*) AS value FROM store WHERE triage_status = 'OPEN' GROUP BY ALL",
))
def open_findings_metric(spark, sf_dir):
    return mo.open_findings_metric(_stored(spark, sf_dir))


@query("scans_by_status", q(common.SCAN_RECORDS, "SELECT repo_id, status, count(*) AS scans FROM records GROUP BY ALL"))
def scans_by_status(spark, sf_dir):
    return mo.scans_by_status(corpora.scan_records(spark, sf_dir))


@query("scan_duration_quantiles", q(
    common.SCAN_RECORDS,
    "SELECT repo_id, quantile_disc(duration_s, 0.5) AS p50, quantile_disc(duration_s, 0.95) AS p95 FROM records GROUP BY repo_id",
))
def scan_duration_quantiles(spark, sf_dir):
    return mo.scan_durations(corpora.scan_records(spark, sf_dir))


@query("detector_health", q(
    common.DETECTOR_RUNS,
    "SELECT detector_id, count(*) AS runs, quantile_disc(duration_s, 0.95) AS p95, round(avg(failed::DOUBLE), 9) AS error_rate FROM runs GROUP BY detector_id",
))
def detector_health(spark, sf_dir):
    health = mo.detector_health(corpora.detector_runs(spark, sf_dir))
    return health.withColumn("error_rate", F.round("error_rate", 9))


@query("stored_duration_sketches", q(
    common.SCAN_RECORDS, "SELECT repo_id, count(*) AS runs, true AS p50_fits, true AS p95_fits, true AS distinct_fits FROM records GROUP BY repo_id",
))
def stored_duration_sketches(spark, sf_dir):
    """Two increments stored as daily sketches and merged; the merged figures are held against the
    exact ranks and counts, as far as their stated errors allow."""
    records, path = corpora.scan_records(spark, sf_dir), work_dir(spark, "sketches")
    for batch in (0, 1):
        st.write_batch(sketches.daily_sketches(records.filter(F.col("id") % 2 == batch), "repo_id", "started_at", of="id"), path, batch)
    stored = spark.read.parquet(path)
    about = lookup_join(sketches.quantiles(stored, "repo_id"), sketches.distinct_values(stored, "repo_id"), ["repo_id"], "inner")
    n = F.count("duration_s")

    def fits(value, share):
        return (F.abs(F.count_if(F.col("duration_s") <= F.col(value)) / n - share) <= sketches.RANK_ERROR + F.count_if(F.col("duration_s") == F.col(value)) / n).alias(f"{value}_fits")

    ids = F.count_distinct("id")
    return lookup_join(records, about, ["repo_id"], "inner").groupBy("repo_id", "runs").agg(
        fits("p50", 0.5), fits("p95", 0.95), (F.abs(F.any_value("distinct_values") - ids) <= 0.04 * ids).alias("distinct_fits"),
    )


@query("active_detectors", q(common.DETECTOR_RUNS, "SELECT count(DISTINCT detector_id) AS detectors FROM runs"))
def active_detectors(spark, sf_dir):
    return mo.active_detectors(corpora.detector_runs(spark, sf_dir))


@query("coverage", q(
    f"{common.FLAGGED}, {common.REPOSITORIES}, {common.SCAN_RECORDS}, lastr AS (SELECT replace(repo_id, 'repo', 'src') AS name, max(started_at) AS at_s FROM records GROUP BY ALL), "
    "gates AS (SELECT u.repo_id AS name, count(f.repo_id) FILTER (NOT suppressed AND severity_rank >= 3) = 0 AS passed FROM (SELECT DISTINCT repo_id FROM units) u LEFT JOIN flagged f USING (repo_id) GROUP BY u.repo_id)",
    f"SELECT count(*) AS repos, count(at_s) AS scanned, count(at_s) / count(*) AS share_scanned, count(*) FILTER (NOT passed) AS gate_fail, max({common.NOW} - at_s) AS longest_gap_s FROM repos LEFT JOIN lastr USING (name) LEFT JOIN gates USING (name)",
))
def coverage(spark, sf_dir):
    records = corpora.scan_records(spark, sf_dir).withColumn("repo_id", F.regexp_replace("repo_id", "^repo", "src"))
    gates = govern.evaluate_gate(common.flagged(spark, sf_dir), repos=common.repos(spark, sf_dir))
    return mo.coverage(
        corpora.repositories(spark, sf_dir), records,
        materialise(gates, "gates"), F.timestamp_seconds(F.lit(common.NOW)),
    )


@query("scan_progress", q(
    common.SCAN_RECORDS,
    "SELECT repo_id AS scan_id, (10 + floor(85.0 * count(*) FILTER (status IN ('COMPLETED','FAILED','CANCELLED')) / greatest(1, count(*)) + 0.5))::INTEGER AS progress FROM records GROUP BY repo_id",
))
def scan_progress(spark, sf_dir):
    done = F.col("status").isin("COMPLETED", "FAILED", "CANCELLED")
    return mo.scan_progress(
        corpora.scan_records(spark, sf_dir).select(F.col("repo_id").alias("scan_id"), done.alias("done"))
    )


@query("top_repos_by_risk", q(
    common.STORE,
    f"SELECT repo_id, sum({list(mo.RISK_WEIGHTS)}[severity_rank + 1])::BIGINT AS risk, count(*) AS open_findings FROM store WHERE triage_status = 'OPEN' GROUP BY repo_id ORDER BY risk DESC, repo_id LIMIT 10",
))
def top_repos_by_risk(spark, sf_dir):
    return mo.top_repos_by_risk(_stored(spark, sf_dir))


@query("gate_fail_quota", q(
    f"{common.FLAGGED}, gates AS (SELECT u.repo_id, count(f.repo_id) FILTER (NOT suppressed AND severity_rank >= 3) = 0 AS passed FROM (SELECT DISTINCT repo_id FROM units) u LEFT JOIN flagged f USING (repo_id) GROUP BY u.repo_id)",
    "SELECT count(*) AS repos, count(*) FILTER (NOT passed) AS failing, count(*) FILTER (NOT passed) / count(*) AS quota FROM gates",
))
def gate_fail_quota(spark, sf_dir):
    return mo.gate_fail_quota(govern.evaluate_gate(common.flagged(spark, sf_dir), repos=common.repos(spark, sf_dir)))


@query("finding_trend", q(
    common.AGG,
    "SELECT strftime(make_timestamp(first_seen * 1000000), '%Y-%m-%d') AS day, severity, count(*) AS new_findings FROM agg GROUP BY ALL",
))
def finding_trend(spark, sf_dir):
    return mo.finding_trend(common.aggregated(spark, sf_dir))


@query("remediation_metrics", (
    "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN user_id % 2 = 0 THEN 'auto-fix' ELSE 'scrub-execute' END AS type, "
    "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'blocked' END AS result, count(*) AS actions FROM events GROUP BY ALL"
))
def remediation_metrics(spark, sf_dir):
    actions = corpora.read_table(spark, sf_dir, "events").select(
        F.timestamp_seconds(corpora.event_seconds()).alias("at"),
        F.when(F.col("user_id") % 2 == 0, F.lit("auto-fix")).otherwise(F.lit("scrub-execute")).alias("type"),
        F.when(F.col("event_type") == "purchase", F.lit("success"))
        .when(F.col("event_type") == "error", F.lit("error"))
        .otherwise(F.lit("blocked")).alias("result"),
    )
    return mo.remediation_metrics(actions)


# --- batch alerts -------------------------------------------------------------------

def sliding(width: int, slide: int) -> str:
    """All window starts that cover second ``t``."""
    n = width // slide
    return f"unnest(list_transform(range(0, {n}), lambda k: t - t % {slide} - k * {slide})) AS window_start"


@query("alert_new_critical", q(
    common.AGG,
    f"SELECT window_start, count(*) AS n FROM (SELECT {sliding(900, 300)} FROM (SELECT first_seen AS t FROM agg WHERE severity = 'CRITICAL')) GROUP BY window_start",
))
def alert_new_critical(spark, sf_dir):
    return plain(mo.alert_new_critical(common.aggregated(spark, sf_dir), "first_seen"))


def gate_events(spark, sf_dir):
    """Scan records as gate readings: red after a failure or cancellation."""
    red = F.col("status").isin("FAILED", "CANCELLED", "RUNNING").cast("int")
    return corpora.scan_records(spark, sf_dir).select("repo_id", F.col("started_at").alias("ts"), red.alias("gate"))


@query("alert_gate_fail", q(
    common.SCAN_RECORDS,
    "SELECT window_start, repo_id FROM (SELECT started_at - started_at % 300 AS window_start, repo_id, min((status IN ('FAILED','CANCELLED','RUNNING'))::INT) AS red FROM records GROUP BY ALL) WHERE red = 1",
))
def alert_gate_fail(spark, sf_dir):
    return plain(mo.alert_gate_fail(gate_events(spark, sf_dir)))


@query("alert_error_rate", q(
    common.DETECTOR_RUNS,
    f"SELECT window_start, detector_id, count(*) AS n, round(count(*) / 900.0, 9) AS rate FROM (SELECT detector_id, {sliding(900, 300)} FROM (SELECT detector_id, ts AS t FROM runs WHERE failed)) GROUP BY ALL HAVING count(*) / 900.0 > 0.002",
))
def alert_error_rate(spark, sf_dir):
    found = mo.alert_error_rate(corpora.detector_runs(spark, sf_dir), per_second=0.002)
    return plain(found.withColumn("rate", F.round("rate", 9)))


@query("alert_stale_repo", q(
    common.SCAN_RECORDS,
    f"SELECT repo_id, max(started_at) AS last_at FROM records WHERE status = 'COMPLETED' GROUP BY repo_id HAVING max(started_at) < {corpora.EPOCH_2024 + 59 * 86400 + 72000 - 30 * 86400}",
))
def alert_stale_repo(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(corpora.EPOCH_2024 + 59 * 86400 + 72000))
    completed = corpora.scan_records(spark, sf_dir).filter("status = 'COMPLETED'")
    return plain(mo.alert_stale_repo(completed, now))


@query("scan_rate_per_repo", q(
    common.SCAN_RECORDS,
    f"SELECT window_start, repo_id, count(*) AS n, round(count(*) / 3600.0, 9) AS per_second FROM (SELECT repo_id, {sliding(3600, 900)} FROM (SELECT repo_id, started_at AS t FROM records)) GROUP BY ALL",
))
def scan_rate_per_repo(spark, sf_dir):
    rates = mo.scan_rate_per_repo(corpora.scan_records(spark, sf_dir))
    return plain(rates.withColumn("per_second", F.round("per_second", 9)))


SESSIONS_SQL = (
    "marked AS (SELECT *, CASE WHEN started_at - lag(started_at) OVER w <= 1800 THEN 0 ELSE 1 END AS opens FROM records WINDOW w AS (PARTITION BY repo_id ORDER BY started_at, id)), "
    "numbered AS (SELECT *, sum(opens) OVER (PARTITION BY repo_id ORDER BY started_at, id) AS session FROM marked)"
)


@query("scan_sessions", q(
    f"{common.SCAN_RECORDS}, {SESSIONS_SQL}",
    "SELECT min(started_at) AS session_start, max(started_at) + 1800 AS session_end, repo_id, count(*) AS n, arg_max(status, {'a': started_at, 'b': id}) AS last_status FROM numbered GROUP BY repo_id, session",
))
def scan_sessions(spark, sf_dir):
    return plain(mo.scan_sessions(corpora.scan_records(spark, sf_dir)))


@query("lookback_counts", q(
    common.SCAN_RECORDS,
    "SELECT DISTINCT repo_id, m AS minute, n FROM (SELECT repo_id, m, sum(c) OVER (PARTITION BY repo_id ORDER BY m RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM (SELECT repo_id, started_at - started_at % 60 AS m, count(*) AS c FROM records GROUP BY ALL))",
))
def lookback_counts(spark, sf_dir):
    counted = mo.lookback_counts(corpora.scan_records(spark, sf_dir), "started_at", 3600, "repo_id")
    return counted.select("repo_id", "minute", "n")


@query("severity_at_least", q(
    common.AGG, "SELECT repo_id, fingerprint, severity_rank >= 3 AS high, severity_rank >= 2 AS medium FROM agg",
))
def severity_at_least(spark, sf_dir):
    found = common.aggregated(spark, sf_dir)
    return found.select(
        "repo_id", "fingerprint",
        text.at_least(F.col("severity"), "HIGH").alias("high"), text.at_least(F.col("severity"), "MEDIUM").alias("medium"),
    )


@query("countable_findings", q(
    common.FLAGGED, "SELECT repo_id, fingerprint FROM flagged WHERE NOT suppressed AND NOT baseline AND severity_rank >= 2",
))
def countable_findings(spark, sf_dir):
    counts = govern.countable(F.lit("MEDIUM"), F.lit(True))
    return common.flagged(spark, sf_dir).filter(counts).select("repo_id", "fingerprint")
