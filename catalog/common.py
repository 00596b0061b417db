"""Tables that many queries start from, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import sql
from veilscan.operators import findings as fo, govern
from veilscan.operators.detect import ScanConfig, detect
from veilscan.operators.findings import Suppression
from veilscan.session import materialise
from veilscan.sources import corpora

CONFIG = ScanConfig(groups=("secrets", "pii"))
ACCEPTED_BEFORE = corpora.EPOCH_2024 + 8 * 3600
NOW = corpora.EPOCH_2024 + 30 * 86400
SUPPRESSIONS = (
    Suppression("src/de/**", "secrets", "vendored"),
    Suppression("**/*.md", "pii.patterns", "documentation"),
    Suppression("src/{fr,es}/?[0-4]*.java", "", "generated"),
)
SUPPRESSED_SQL = (
    "((path LIKE 'src/de/%' AND category = 'SECRET') "
    "OR (path LIKE '%.md' AND detector_id = 'pii.patterns') "
    "OR regexp_matches(path, '^src/(fr|es)/[^/][0-4][^/]*\\.java$'))"
)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.history_units(corpora.planted_units(spark, sf_dir))


HISTORY = sql.history(sql.PLANTED)


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository that was scanned."""
    return history(spark, sf_dir).select("repo_id").distinct()


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(history(spark, sf_dir), CONFIG)


RAW = sql.findings_ctes(HISTORY, CONFIG)


def aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.aggregate_findings(raw(spark, sf_dir))


AGG = f"{RAW}, {sql.aggregate_ctes()}"


def baseline(found: DataFrame) -> DataFrame:
    """What had been accepted by eight o'clock of the first day."""
    early = found.filter(F.col("first_seen") < F.timestamp_seconds(F.lit(ACCEPTED_BEFORE)))
    return fo.generate_baseline(early, "lead", "brownfield", "2024-01-01T08:00:00Z")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with both flags. They are written once, as a store would hold them,
    because the baseline and later joins read them again."""
    found = materialise(fo.apply_path_rules(aggregated(spark, sf_dir), SUPPRESSIONS), "findings")
    return fo.apply_baseline(found, baseline(found))


_REST = (
    "repo_id, fingerprint, detector_id, category, severity, severity_rank, rule_id, path, line_no, "
    "redacted_match, verified, commit_id, first_seen, last_seen, occurrences"
)
FLAGGED = (
    f"{AGG}, base AS (SELECT DISTINCT fingerprint FROM agg WHERE first_seen < {ACCEPTED_BEFORE}), "
    f"flagged AS (SELECT {_REST}, {SUPPRESSED_SQL} AS suppressed, "
    "fingerprint IN (SELECT fingerprint FROM base) AS baseline FROM agg)"
)


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan_id = F.concat(F.lit("scan-"), F.col("repo_id"))
    return govern.stored_findings(flagged(spark, sf_dir), scan_id)


STORE = (
    f"{FLAGGED}, store AS (SELECT sha256('scan-' || repo_id || '/' || repo_id || '/' || fingerprint) AS id, "
    "'scan-' || repo_id AS scan_id, repo_id, fingerprint, detector_id, category, severity, severity_rank, "
    "rule_id, path, line_no, redacted_match, verified, first_seen, last_seen, occurrences, "
    "CASE WHEN suppressed THEN 'SUPPRESSED' WHEN baseline THEN 'BASELINE' ELSE 'OPEN' END AS triage_status, "
    "NULL::VARCHAR AS triage_reason, 'OPEN' AS remediation_status FROM flagged)"
)
STORE_COLUMNS = (
    "id", "scan_id", "repo_id", "fingerprint", "detector_id", "category", "severity",
    "severity_rank", "rule_id", "path", "line_no", "redacted_match", "verified", "first_seen",
    "last_seen", "occurrences", "triage_status", "triage_reason", "remediation_status",
)

SECONDS = "(epoch_us(ts) // 1000000)"
SCAN_RECORDS = (
    "records AS (SELECT event_id AS id, 'repo' || (user_id % 20) AS repo_id, "
    "CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'QUEUED' "
    "WHEN 'view' THEN 'RUNNING' ELSE 'CANCELLED' END AS status, "
    "(CASE WHEN event_type IN ('purchase','error','click') THEN 100 ELSE event_id % 100 END)::INTEGER AS progress, "
    f"{SECONDS} AS started_at, CASE WHEN event_type IN ('purchase','error','click') THEN {SECONDS} + floor(value)::BIGINT END AS finished_at, "
    f"CASE WHEN event_type = 'view' AND event_id % 3 <> 0 THEN {SECONDS} END AS claimed_at, "
    "value AS duration_s, CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error_message FROM events)"
)
DETECTORS = sql.strings(corpora._DETECTORS)
DETECTOR_RUNS = (
    f"runs AS (SELECT {DETECTORS}[user_id % 6 + 1] AS detector_id, {SECONDS} AS ts, value AS duration_s, "
    "event_type = 'error' AS failed FROM events)"
)
REPOSITORIES = (
    "repos AS (SELECT name, n, (['github','gitlab','local'])[n % 3 + 1] AS type, "
    "CASE n % 5 WHEN 0 THEN 'git@github.com:org/' || name || '.git' WHEN 1 THEN 'https://bitbucket.org/team/' || name "
    "WHEN 2 THEN 'ssh://git@gitlab.com:22/grp/' || name || '.git' WHEN 3 THEN '/srv/git/' || name "
    "ELSE 'https://bob@code.example.org/x/' || name || '.git/' END AS location, "
    "CASE WHEN n % 2 = 0 THEN ['main','dev'] ELSE [] END AS branches, n % 4 <> 0 AS enabled, "
    "n % 3 <> 1 AS remediation_enabled, 'Corpus ' || name AS description, "
    "'org' || (n % 3) || '/team' || (n % 2) || '/' || name AS org_unit, n % 6 = 0 AS archived "
    "FROM (SELECT DISTINCT source AS name, regexp_extract(source, '(\\d+)$', 1)::INTEGER AS n FROM documents))"
)
