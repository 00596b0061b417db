"""Queries for caller-supplied detectors, verifiers and fix proposers, and a scan
with every optional input."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog import common, sql
from catalog.registry import plain, query
from catalog.sources import PEPPER, _WORDS
from veilscan.operators import findings as fo, govern
from veilscan.operators.detect import FINDING_COLUMNS, ScanConfig
from veilscan.operators.registry import Plugin, Registry, batch_outcomes, degradations, outcome_findings
from veilscan.plans.history import scan_history
from veilscan.plans.scan import ScanInputs, scan
from veilscan.session import materialise
from veilscan.sources import corpora, values as vs
from veilscan.sources.units import explode_lines

q = sql.with_query
TICKET = r"CUST-\d{4,8}|\d{5,}"


def ticket_numbers(line: str):
    """A foreign detector that cannot cope with some lines."""
    if "###" in line:
        raise ValueError("unreadable line")
    for m in re.finditer(TICKET, line, re.ASCII):
        yield "ticket-number", "LOW", m.group()


def _outcomes(lines):
    return batch_outcomes(lines, ticket_numbers)


def _plugin() -> Plugin:
    return Plugin(
        "custom.tickets", "CUSTOM",
        lambda lines: outcome_findings(_outcomes(lines), "custom.tickets", "CUSTOM"),
        ("SOURCE", "CONFIG", "DOCUMENTATION"),
    )


_PLUGIN_LINES = sql.lines_ctes(sql.PLANTED)


@query("plugin_detector", q(
    _PLUGIN_LINES,
    f"SELECT repo_id, 'custom.tickets' AS detector_id, 'CUSTOM' AS category, 'LOW' AS severity, 'ticket-number' AS rule_id, path, line_no, {sql.REDACT} AS redacted_match, commit_id, ts, false AS verified "
    f"FROM (SELECT *, unnest(regexp_extract_all(line, {sql.lit(TICKET)})) AS m FROM lines WHERE NOT contains(line, '###') AND NOT contains(line, 'scanner:ignore-line') AND NOT contains(coalesce(prev_line, ''), 'scanner:ignore-next-line') AND file_type IN ('SOURCE','CONFIG','DOCUMENTATION'))",
))
def plugin_detector(spark, sf_dir):
    registry = Registry()
    registry.add(_plugin())
    return plain(registry.run(corpora.planted_units(spark, sf_dir)), *FINDING_COLUMNS)


@query("plugin_degradations", q(
    _PLUGIN_LINES,
    "SELECT repo_id, 'custom.tickets on ' || path || '@' || left(commit_id, 8) || ': error: ValueError: unreadable line' AS message, count(*) AS failed_lines FROM lines WHERE contains(line, '###') GROUP BY ALL",
))
def plugin_degradations(spark, sf_dir):
    lines = explode_lines(corpora.planted_units(spark, sf_dir))
    return degradations(_outcomes(lines), "custom.tickets")


@query("plugin_proposals", q(
    common.STORE,
    "SELECT finding_id, strategy, new_content FROM (SELECT id AS finding_id, CASE WHEN rule_id = 'private-key' THEN 'REMOVE_LINE' ELSE 'REDACT' END AS strategy, CASE WHEN rule_id = 'private-key' THEN '' ELSE '***REMOVED***' END AS new_content FROM store WHERE category = 'SECRET' "
    "UNION ALL SELECT id, 'EXTERNALIZE', 'System.getenv(\"API_KEY\")' FROM store WHERE rule_id = 'generic-api-key')",
))
def plugin_proposals(spark, sf_dir):
    def externalize(findings):
        rows = findings.filter(F.col("rule_id") == "generic-api-key")
        return rows.select(
            F.col("id").alias("finding_id"), "repo_id", "path", F.col("line_no").alias("start_line"),
            F.col("line_no").alias("end_line"), F.lit('System.getenv("API_KEY")').alias("new_content"),
            F.lit("EXTERNALIZE").alias("strategy"), F.lit("LOW").alias("confidence"), F.lit("use the environment").alias("summary"),
        )

    registry = Registry()
    registry.add_proposer("externalize", externalize)
    stored = common.store(spark, sf_dir)
    return registry.propose(stored, govern.proposals(stored)).select("finding_id", "strategy", "new_content")


_EVERYTHING = (
    f"{common.RAW}, {_WORDS}, all_numbered AS (SELECT * FROM numbered WHERE file_type <> 'BINARY'), "
    "tok AS (SELECT *, unnest(regexp_extract_all(line, '[\\p{L}\\p{Nd}_]+')) AS m FROM all_numbered), "
    f"valued AS (SELECT DISTINCT repo_id, 'pii.customer-data-api' AS detector_id, 'PII' AS category, 'HIGH' AS severity, 'passage_word' AS rule_id, path, line_no, {sql.REDACT} AS redacted_match, commit_id, ts, false AS verified, m FROM tok WHERE m IN (SELECT value FROM words)), "
    f"hashed AS (SELECT repo_id, 'pii.customer-data-api' AS detector_id, 'PII' AS category, 'HIGH' AS severity, 'hashed_word' AS rule_id, path, line_no, {sql.REDACT} AS redacted_match, commit_id, ts, false AS verified FROM tok WHERE length(m) >= 4 AND m IN (SELECT value FROM words)), "
    f"everything AS (SELECT {sql.RAW_COLUMNS} FROM raw UNION ALL SELECT {sql.RAW_COLUMNS} FROM valued UNION ALL SELECT {sql.RAW_COLUMNS} FROM hashed), "
    f"verified AS (SELECT * REPLACE (CASE WHEN act THEN 'CRITICAL' ELSE severity END AS severity, act AS verified) FROM (SELECT *, rule_id = 'private-key' OR rule_id = 'slack-token' AS act FROM everything)), "
    f"{sql.aggregate_ctes('verified')}"
)


@query("scan_with_all_inputs", q(
    _EVERYTHING,
    f"SELECT repo_id, fingerprint, rule_id, severity, verified, occurrences, first_seen, last_seen, {common.SUPPRESSED_SQL} AS suppressed, first_seen < {common.ACCEPTED_BEFORE} AND severity = 'MEDIUM' AS baseline FROM agg",
))
def scan_with_all_inputs(spark, sf_dir):
    """Patterns, known values, hashed values, verification, suppression, baseline."""
    units = common.history(spark, sf_dir)
    words = corpora.passage_words(spark, sf_dir)
    hashes = vs.hash_values(words.select(F.lit("hashed_word").alias("key"), "value"), PEPPER)
    patterns = materialise(common.raw(spark, sf_dir), "patterns")
    active = fo.with_fingerprint(patterns).filter(F.col("rule_id").isin("private-key", "slack-token"))
    early = F.col("first_seen") < F.timestamp_seconds(F.lit(common.ACCEPTED_BEFORE))
    accepted = fo.aggregate_findings(patterns).filter(early & (F.col("severity") == "MEDIUM"))
    inputs = ScanInputs(
        values=words,
        value_hashes=hashes,
        pepper=PEPPER,
        verifications=active.select("fingerprint", F.lit("ACTIVE").alias("status")),
        suppressions=common.SUPPRESSIONS,
        baseline=materialise(accepted.select("fingerprint"), "accepted"),
    )
    found = scan(units, common.CONFIG, inputs)
    return plain(
        found, "repo_id", "fingerprint", "rule_id", "severity", "verified", "occurrences",
        "first_seen", "last_seen", "suppressed", "baseline",
    )


_MIXED = f"{sql.history(sql.PLANTED)} UNION ALL {sql.INFRASTRUCTURE}"


@query("scan_history_blobs", q(
    sql.findings_ctes(_MIXED, ScanConfig()), f"SELECT {sql.RAW_COLUMNS} FROM raw",
))
def scan_history_blobs(spark, sf_dir):
    """History and infrastructure files, every distinct content scanned once."""
    units = common.history(spark, sf_dir).unionByName(corpora.infrastructure_units(spark, sf_dir))
    keyed = units.withColumn("blob_id", F.sha2("content", 256))
    documents = corpora.planted_units(spark, sf_dir).unionByName(corpora.infrastructure_units(spark, sf_dir))
    blobs = documents.select(F.sha2("content", 256).alias("blob_id"), "content").dropDuplicates(["blob_id"])
    return plain(scan_history(keyed.drop("content"), blobs, ScanConfig()), *FINDING_COLUMNS)
