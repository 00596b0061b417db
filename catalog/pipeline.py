"""Queries from raw findings to verdicts, triage and remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common, sql
from catalog.registry import plain, query
from veilscan.functions import fixed_values as fv, text
from veilscan.operators import findings as fo, govern, rulesets
from veilscan.operators.detect import EntropyConfig, ScanConfig, detect
from veilscan.operators.lookups import keep_known
from veilscan.operators.scrub import remaining_open, remaining_secrets, scrub_content
from veilscan.plans.scan import ScanInputs, raw_findings, scan
from veilscan.session import materialise, work_dir
from veilscan.sources import corpora, decisions as dl, store as st

q = sql.with_query


@query("scan_gate_verdicts", q(
    f"{sql.findings_ctes(sql.ALL_UNITS, ScanConfig().with_rules_on(('phone',)))}, {sql.aggregate_ctes()}",
    "SELECT repo_id, count(agg.path) AS findings, count(*) FILTER (severity_rank >= 3) AS blocking_count, "
    "count(*) FILTER (severity_rank >= 2) AS warn_count, count(*) FILTER (severity_rank >= 3) = 0 AS passed, "
    "(CASE WHEN count(*) FILTER (severity_rank >= 3) = 0 THEN 0 ELSE 1 END)::INTEGER AS exit_code "
    "FROM (SELECT DISTINCT repo_id FROM units) LEFT JOIN agg USING (repo_id) GROUP BY repo_id",
))
def scan_gate_verdicts(spark, sf_dir):
    """All detectors, phone included, over every unit; one verdict per repository, clean ones
    included."""
    units = corpora.all_units(spark, sf_dir)
    found = scan(units, ScanConfig().with_rules_on(("phone",)))
    counted = found.groupBy("repo_id").agg(
        F.count("*").alias("findings"),
        F.count_if(govern.countable(F.lit("HIGH"), F.lit(False))).alias("blocking_count"),
        F.count_if(govern.countable(F.lit("MEDIUM"), F.lit(False))).alias("warn_count"),
    )
    counted = units.select("repo_id").distinct().join(counted, "repo_id", "left").na.fill(0)
    return counted.withColumn("passed", F.col("blocking_count") == 0).withColumn(
        "exit_code", F.when(F.col("passed"), 0).otherwise(1)
    )


@query("card_gate", q(
    f"{sql.findings_ctes(sql.TEXTS, ScanConfig(groups=('pii',), pii_patterns=('creditcard',), allowed_cards=()))}, {sql.aggregate_ctes()}",
    "SELECT repo_id, count(*) AS blocking_count, count(*) AS warn_count, 'HIGH' AS fail_on, true AS soft_fail, "
    "false AS passed, 3::INTEGER AS exit_code FROM agg GROUP BY repo_id",
))
def card_gate(spark, sf_dir):
    """The smallest whole slice: cards in documents, deduplicated, judged per source."""
    config = ScanConfig(groups=("pii",), pii_patterns=("creditcard",), allowed_cards=())
    return govern.evaluate_gate(scan(corpora.text_units(spark, sf_dir), config), soft_fail=True)


_BROKEN = (
    "broken AS (SELECT repo_id, detector_id, category, CASE WHEN line_no % 5 = 0 THEN 'SEVERE' ELSE severity END AS severity, "
    "CASE WHEN line_no % 7 = 0 THEN '  ' ELSE rule_id END AS rule_id, path, (line_no - 3)::INTEGER AS line_no, "
    "CASE WHEN line_no % 11 = 0 THEN NULL ELSE redacted_match END AS redacted_match, commit_id FROM raw)"
)


@query("validate_findings", q(
    f"{common.RAW}, {_BROKEN}",
    "SELECT repo_id, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS rejected FROM (SELECT *, "
    f"{sql.in_list('severity', fv.SEVERITIES)} AND trim(rule_id) <> '' AND line_no >= 1 AND redacted_match IS NOT NULL AS ok FROM broken) GROUP BY repo_id",
))
def validate_findings(spark, sf_dir):
    found = common.raw(spark, sf_dir).withColumns({
        "severity": F.when(F.col("line_no") % 5 == 0, F.lit("SEVERE")).otherwise(F.col("severity")),
        "rule_id": F.when(F.col("line_no") % 7 == 0, F.lit("  ")).otherwise(F.col("rule_id")),
        "redacted_match": F.when(F.col("line_no") % 11 != 0, F.col("redacted_match")),
        "line_no": F.col("line_no") - 3,
    })
    good, rejected = fo.validate_findings(found)
    both = good.select("repo_id", F.lit(1).alias("v"), F.lit(0).alias("r")).unionByName(
        rejected.select("repo_id", F.lit(0).alias("v"), F.lit(1).alias("r"))
    )
    return both.groupBy("repo_id").agg(F.sum("v").alias("valid"), F.sum("r").alias("rejected"))


@query("aggregate_findings", q(common.AGG, "SELECT * FROM agg"))
def aggregate_findings(spark, sf_dir):
    return plain(common.aggregated(spark, sf_dir))


_VERIFIED = (
    f"checked AS (SELECT *, {sql.FINGERPRINT} AS fingerprint FROM raw), "
    "results AS (SELECT DISTINCT fingerprint, (['ACTIVE','UNVERIFIED','INACTIVE','ERROR'])[line_no % 4 + 1] AS status "
    "FROM checked WHERE category = 'SECRET')"
)


def _verifications(found):
    marked = fo.with_fingerprint(found).filter(F.col("category") == "SECRET")
    names = F.array(*[F.lit(s) for s in ("ACTIVE", "UNVERIFIED", "INACTIVE", "ERROR")])
    return marked.select("fingerprint", F.element_at(names, F.col("line_no") % 4 + 1).alias("status")).distinct()


@query("verify_and_escalate", q(
    f"{common.RAW}, {_VERIFIED}",
    "SELECT repo_id, rule_id, path, line_no, commit_id, CASE WHEN status = 'ACTIVE' THEN 'CRITICAL' ELSE severity END AS severity, "
    "coalesce(status = 'ACTIVE', false) AS verified FROM checked LEFT JOIN results USING (fingerprint)",
))
def verify_and_escalate(spark, sf_dir):
    found = materialise(common.raw(spark, sf_dir), "raw")
    return fo.verify_and_escalate(found, _verifications(found)).select(
        "repo_id", "rule_id", "path", "line_no", "commit_id", "severity", "verified"
    )


@query("path_suppression_and_baseline", q(
    common.FLAGGED, "SELECT repo_id, fingerprint, path, detector_id, suppressed, baseline FROM flagged",
))
def path_suppression_and_baseline(spark, sf_dir):
    return common.flagged(spark, sf_dir).select(
        "repo_id", "fingerprint", "path", "detector_id", "suppressed", "baseline"
    )


@query("new_findings", q(
    common.FLAGGED, "SELECT repo_id, fingerprint, rule_id FROM agg WHERE fingerprint NOT IN (SELECT fingerprint FROM base)",
))
def new_findings(spark, sf_dir):
    found = materialise(common.aggregated(spark, sf_dir), "aggregated")
    return fo.new_findings(found, common.baseline(found)).select("repo_id", "fingerprint", "rule_id")


@query("generate_baseline", q(
    common.AGG,
    "SELECT DISTINCT fingerprint, 'lead' AS accepted_by, '2024-02-01' AS accepted_at, 'reviewed' AS reason FROM agg",
))
def generate_baseline(spark, sf_dir):
    return fo.generate_baseline(common.aggregated(spark, sf_dir), "lead", "reviewed", "2024-02-01")


@query("baseline_round_trip", q(
    common.AGG,
    "SELECT 1::INTEGER AS version, '2024-02-01T00:00:00Z' AS generated_at, fingerprint, 'lead' AS accepted_by, "
    "'2024-02-01' AS accepted_at, NULL::VARCHAR AS reason FROM (SELECT DISTINCT fingerprint FROM agg)",
))
def baseline_round_trip(spark, sf_dir):
    """Entries written as baseline files and read back."""
    found = common.aggregated(spark, sf_dir).select("fingerprint").distinct()
    entries = found.select(
        "fingerprint", F.lit("lead").alias("accepted_by"), F.lit("2024-02-01").alias("accepted_at"),
        F.lit(None).cast("string").alias("reason"),
    )
    path = work_dir(spark, "baseline")
    st.write_baseline(entries, path, "2024-02-01T00:00:00Z")
    return st.read_baseline(spark, path)


@query("drop_allowlisted", q(
    sql.lines_ctes(sql.PLANTED) + f", cards AS ({sql.card_source()})",
    f"SELECT repo_id, path, line_no, {sql.REDACT} AS redacted_match FROM cards WHERE {sql.luhn(sql.DIGITS)} "
    f"AND NOT {sql.in_list(sql.DIGITS, sql.plain_values(fv.ALLOWED_CARDS, False))} "
    f"AND {sql.DIGITS} NOT IN (SELECT DISTINCT {sql.DIGITS} FROM cards WHERE {sql.luhn(sql.DIGITS)} AND line_no = 1)",
))
def drop_allowlisted(spark, sf_dir):
    """Cards that are neither well known nor seen on the first line of a document."""
    from veilscan.functions import checks
    from veilscan.operators.detect import CARD_CANDIDATES
    from veilscan.sources.units import explode_lines

    lines = explode_lines(corpora.planted_units(spark, sf_dir))
    lines = lines.filter((text.file_type(F.col("path")) != "BINARY") & F.col("line").rlike(r"\d(?:[ -]?\d){12}"))
    found = lines.select("repo_id", "path", "line_no", F.inline(F.expr(CARD_CANDIDATES)))
    rule = F.lit("creditcard")
    keyed = found.filter(checks.luhn_valid(F.col("match"))).select(
        "repo_id", "path", "line_no", text.redact(F.col("match")).alias("redacted_match"),
        rule.alias("rule_id"), fo.pii_key(F.col("match"), rule).alias("value_key"),
    )
    first_lines = keyed.filter("line_no = 1").select("rule_id", "value_key")
    known = rulesets.pii_allowlist(spark)
    return fo.drop_allowlisted(keyed, first_lines.unionByName(known)).select(
        "repo_id", "path", "line_no", "redacted_match"
    )


# --- gate ---------------------------------------------------------------------------

_GATE = (
    "SELECT repo_id, blocking_count, warn_count, 'HIGH' AS fail_on, {soft} AS soft_fail, blocking_count = 0 AS passed, "
    "(CASE WHEN blocking_count = 0 THEN 0 ELSE {code} END)::INTEGER AS exit_code FROM (SELECT repo_id, "
    "count(*) FILTER (NOT suppressed {new} AND severity_rank >= 3) AS blocking_count, "
    "count(*) FILTER (NOT suppressed {new} AND severity_rank >= 2) AS warn_count "
    "FROM (SELECT DISTINCT repo_id FROM units) LEFT JOIN flagged USING (repo_id) GROUP BY repo_id)"
)


@query("evaluate_gate", q(common.FLAGGED, _GATE.format(soft="false", code=1, new="")))
def evaluate_gate(spark, sf_dir):
    return govern.evaluate_gate(common.flagged(spark, sf_dir), repos=common.repos(spark, sf_dir))


@query("evaluate_gate_new_only", q(common.FLAGGED, _GATE.format(soft="true", code=3, new="AND NOT baseline")))
def evaluate_gate_new_only(spark, sf_dir):
    return govern.evaluate_gate(
        common.flagged(spark, sf_dir), fail_on_new_only=True, soft_fail=True, repos=common.repos(spark, sf_dir)
    )


@query("evaluate_raw_gate", q(
    common.RAW,
    "SELECT repo_id, count(*) FILTER (severity = 'CRITICAL') AS blocking_count, 'CRITICAL' AS fail_on, false AS soft_fail, "
    "count(*) FILTER (severity = 'CRITICAL') = 0 AS passed, (CASE WHEN count(*) FILTER (severity = 'CRITICAL') = 0 THEN 0 ELSE 1 END)::INTEGER AS exit_code "
    "FROM (SELECT DISTINCT repo_id FROM units) LEFT JOIN raw USING (repo_id) GROUP BY repo_id",
))
def evaluate_raw_gate(spark, sf_dir):
    return govern.evaluate_raw_gate(common.raw(spark, sf_dir), "CRITICAL", repos=common.repos(spark, sf_dir))


# --- rulesets and policies ----------------------------------------------------------

_RULESETS_SQL = (
    "rs AS (SELECT source AS repo, regexp_extract(source, '(\\d+)$', 1)::INTEGER AS n FROM (SELECT DISTINCT source FROM documents)), "
    "own AS (SELECT repo AS repo_id, 'generic-api-key' AS rule_id, n % 2 = 0 AS enabled, "
    "CASE WHEN n % 3 = 0 THEN 'LOW' END AS severity, 'ALWAYS' AS match_mode FROM rs UNION ALL "
    "SELECT repo, 'email', true, 'HIGH', CASE WHEN n % 5 = 0 THEN 'API' ELSE 'ALWAYS' END FROM rs), "
    "shared AS (SELECT * FROM (VALUES ('phone', true, 'LOW', 'ALWAYS'), ('iban', false, NULL, 'ALWAYS'), "
    "('email', false, NULL, 'ALWAYS'), ('slack-token', true, 'critical', 'ALWAYS')) t(rule_id, enabled, severity, match_mode))"
)


def _rulesets(spark, sf_dir):
    """Three global sets, one of them off, and one set per document source."""
    rule = "struct<rule_id:string,enabled:boolean,severity:string,match_mode:string,source_name:string>"

    def rules(*rows):
        return F.array(*[F.struct(*[F.lit(v) for v in r]).cast(rule) for r in rows])

    shared = spark.range(3).select(
        F.col("id").cast("string").alias("id"),
        F.col("id").cast("int").alias("position"),
        F.concat(F.lit("global "), F.col("id")).alias("name"),
        F.when(F.col("id") == 2, F.lit("DISABLED")).otherwise(F.lit("ACTIVE")).alias("enforcement"),
        F.lit(True).alias("global"),
        F.array().cast("array<string>").alias("repo_names"),
        F.when(F.col("id") == 0, rules(
            ("phone", False, None, "ALWAYS", None), ("iban", False, None, "ALWAYS", None),
            ("email", False, None, "ALWAYS", None),
        )).when(F.col("id") == 1, rules(
            ("phone", True, "LOW", None, None), ("slack-token", True, "critical", None, None),
        )).otherwise(rules(("creditcard", False, None, "ALWAYS", None))).alias("rules"),
    )
    n = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    none = F.lit(None).cast("string")
    own = corpora.repositories(spark, sf_dir).select(
        F.concat(F.lit("own-"), "name").alias("id"),
        (n + 10).alias("position"),
        "name",
        F.lit("ACTIVE").alias("enforcement"),
        F.lit(False).alias("global"),
        F.array("name").alias("repo_names"),
        F.array(
            F.struct(F.lit("generic-api-key"), n % 2 == 0, F.when(n % 3 == 0, F.lit("LOW")), F.lit("ALWAYS"), none).cast(rule),
            F.struct(F.lit("email"), F.lit(True), F.lit("HIGH"), F.when(n % 5 == 0, F.lit("API")).otherwise(F.lit("ALWAYS")), none).cast(rule),
        ).alias("rules"),
    )
    return shared.unionByName(own)


_PHONE_ON = common.CONFIG.with_rules_on(("phone",))


@query("resolve_rules", q(
    f"{sql.findings_ctes(sql.PLANTED, common.CONFIG)}, {_RULESETS_SQL}",
    "SELECT DISTINCT r.repo_id, r.rule_id, coalesce(o.enabled, s.enabled) AS enabled, "
    "CASE WHEN o.rule_id IS NOT NULL THEN o.severity ELSE s.severity END AS severity, "
    "coalesce(o.match_mode, s.match_mode) AS match_mode "
    "FROM raw r LEFT JOIN own o USING (repo_id, rule_id) LEFT JOIN shared s ON s.rule_id = r.rule_id",
))
def resolve_rules(spark, sf_dir):
    pairs = detect(corpora.planted_units(spark, sf_dir), common.CONFIG).select("repo_id", "rule_id").distinct()
    return rulesets.resolve_rules(pairs, _rulesets(spark, sf_dir)).select(
        "repo_id", "rule_id", "override.enabled", "override.severity", "override.match_mode"
    )


@query("apply_rule_overrides", q(
    f"{sql.findings_ctes(sql.PLANTED, _PHONE_ON)}, {_RULESETS_SQL}",
    "SELECT repo_id, rule_id, path, line_no, redacted_match, coalesce(upper(sev), severity) AS severity FROM ("
    "SELECT r.*, coalesce(o.enabled, s.enabled) AS en, coalesce(o.match_mode, s.match_mode, 'ALWAYS') AS mode, "
    "CASE WHEN o.rule_id IS NOT NULL THEN o.severity ELSE s.severity END AS sev "
    "FROM raw r LEFT JOIN own o USING (repo_id, rule_id) LEFT JOIN shared s ON s.rule_id = r.rule_id) "
    "WHERE mode = 'ALWAYS' AND coalesce(en, rule_id <> 'phone')",
))
def apply_rule_overrides(spark, sf_dir):
    inputs = ScanInputs(rulesets=_rulesets(spark, sf_dir))
    return raw_findings(corpora.planted_units(spark, sf_dir), common.CONFIG, inputs).select(
        "repo_id", "rule_id", "path", "line_no", "redacted_match", "severity"
    )


_POLICIES = [
    ("p0", "org0", "MEDIUM", False, False, ["secrets", "pii"], "LOW"),
    ("p1", "org0/team1", "CRITICAL", True, True, ["secrets"], "HIGH"),
    ("p2", "org1/team0/src4", "HIGH", True, False, ["pii"], "MEDIUM"),
    ("p3", "org1/tea", "INFO", False, False, ["secrets"], "INFO"),
    ("p4", " ", "HIGH", False, True, ["secrets", "pii"], "MEDIUM"),
]
_POLICIES_SQL = (
    "policies(id, org, fail_on, new_only, soft, groups, warn) AS (VALUES "
    + ", ".join(
        f"('{i}', '{o}', '{f}', {str(n).lower()}, {str(s).lower()}, {g}, '{w}')"
        for i, o, f, n, s, g, w in _POLICIES
    )
    + "), chosen AS (SELECT r.name AS repo_id, r.org_unit, coalesce(arg_max(p.id, length(p.org)), 'p4') AS policy_id "
    "FROM repos r LEFT JOIN policies p ON trim(p.org) <> '' AND (r.org_unit = p.org OR starts_with(r.org_unit, p.org || '/')) GROUP BY r.name, r.org_unit)"
)


def _policies(spark):
    return spark.createDataFrame(_POLICIES, rulesets.POLICY_SCHEMA)


@query("resolve_policies", q(
    f"{common.REPOSITORIES}, {_POLICIES_SQL}",
    "SELECT c.repo_id, c.org_unit, c.policy_id, p.fail_on, p.new_only AS fail_on_new_only, p.soft AS soft_fail, "
    "array_to_string(p.groups, ',') AS groups, p.warn AS warn_threshold FROM chosen c JOIN policies p ON p.id = c.policy_id",
))
def resolve_policies(spark, sf_dir):
    repos = corpora.repositories(spark, sf_dir).select(F.col("name").alias("repo_id"), "org_unit")
    return rulesets.resolve_policies(repos, _policies(spark)).withColumn(
        "groups", F.array_join("groups", ",")
    )


@query("policy_gate", q(
    f"{common.FLAGGED}, {common.REPOSITORIES}, {_POLICIES_SQL}, judged AS (SELECT c.repo_id, c.policy_id, p.fail_on, p.soft, "
    "count(*) FILTER (NOT f.suppressed AND NOT (p.new_only AND f.baseline) AND list_contains(p.groups, CASE f.category WHEN 'SECRET' THEN 'secrets' ELSE 'pii' END) "
    f"AND f.severity_rank >= list_position({sql.strings(fv.SEVERITIES)}, p.fail_on) - 1) AS blocking, "
    "count(*) FILTER (NOT f.suppressed AND NOT (p.new_only AND f.baseline) AND list_contains(p.groups, CASE f.category WHEN 'SECRET' THEN 'secrets' ELSE 'pii' END) "
    f"AND f.severity_rank >= list_position({sql.strings(fv.SEVERITIES)}, p.warn) - 1) AS warning "
    "FROM chosen c JOIN policies p ON p.id = c.policy_id LEFT JOIN flagged f ON f.repo_id = c.repo_id GROUP BY ALL)",
    "SELECT repo_id, policy_id, fail_on, soft AS soft_fail, blocking AS blocking_count, warning AS warn_count, blocking = 0 AS passed, "
    "(CASE WHEN blocking = 0 THEN 0 WHEN soft THEN 3 ELSE 1 END)::INTEGER AS exit_code FROM judged",
))
def policy_gate(spark, sf_dir):
    repos = corpora.repositories(spark, sf_dir).select(F.col("name").alias("repo_id"), "org_unit")
    resolved = rulesets.resolve_policies(repos, _policies(spark))
    return govern.evaluate_policy_gate(common.flagged(spark, sf_dir), resolved)


@query("findings_under_policies", q(
    f"{common.FLAGGED}, {common.REPOSITORIES}, {_POLICIES_SQL}",
    "SELECT f.repo_id, f.fingerprint, f.category FROM flagged f LEFT JOIN chosen c ON c.repo_id = f.repo_id LEFT JOIN policies p ON p.id = c.policy_id "
    "WHERE p.id IS NULL OR list_contains(p.groups, CASE f.category WHEN 'SECRET' THEN 'secrets' ELSE 'pii' END)",
))
def findings_under_policies(spark, sf_dir):
    repos = corpora.repositories(spark, sf_dir).select(F.col("name").alias("repo_id"), "org_unit")
    resolved = rulesets.resolve_policies(repos, _policies(spark))
    return govern.findings_under_policies(common.flagged(spark, sf_dir), resolved).select("repo_id", "fingerprint", "category")


# --- store, triage, audit -----------------------------------------------------------

@query("append_findings", q(
    common.STORE,
    f"SELECT {', '.join(common.STORE_COLUMNS)} FROM store UNION ALL SELECT {', '.join(common.STORE_COLUMNS)} "
    "FROM (SELECT * REPLACE (sha256('again-' || repo_id || '/' || repo_id || '/' || fingerprint) AS id, 'again-' || repo_id AS scan_id) FROM store)",
))
def append_findings(spark, sf_dir):
    """The findings of two scans appended to a store on disk, which is then read."""
    path = work_dir(spark, "store")
    found = materialise(common.flagged(spark, sf_dir), "flagged")
    for scan_name in ("scan-", "again-"):
        st.append_findings(govern.stored_findings(found, F.concat(F.lit(scan_name), F.col("repo_id"))), path)
    return plain(spark.read.parquet(path), *common.STORE_COLUMNS)


def _decisions(stored):
    """A decision for every finding, some without reason, unknown or for no finding."""
    n = F.col("line_no") % 6
    names = F.array(*[F.lit(s) for s in ("FALSE_POSITIVE", "SUPPRESSED", "OPEN", "IGNORED", "FALSE_POSITIVE", "OPEN")])
    return stored.select(
        F.when(n == 5, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"),
        F.element_at(names, n + 1).alias("status"),
        F.when(n == 0, F.lit("known sample")).when(n == 1, F.lit("  ")).when(n == 4, F.lit("checked")).alias("reason"),
        F.when(n == 4, F.lit("")).otherwise(F.lit("anna")).alias("actor"),
        F.lit(1).alias("seq"),
        "category",
    )


_DECISIONS = (
    "decisions AS (SELECT CASE WHEN line_no % 6 = 5 THEN id || 'x' ELSE id END AS id, "
    "(['FALSE_POSITIVE','SUPPRESSED','OPEN','IGNORED','FALSE_POSITIVE','OPEN'])[line_no % 6 + 1] AS status, "
    "CASE line_no % 6 WHEN 0 THEN 'known sample' WHEN 1 THEN '  ' WHEN 4 THEN 'checked' END AS reason, "
    "CASE WHEN line_no % 6 = 4 THEN '' ELSE 'anna' END AS actor, category FROM store), "
    "judged AS (SELECT *, CASE WHEN status = 'IGNORED' THEN 'unknown triage status' "
    "WHEN status IN ('SUPPRESSED','FALSE_POSITIVE') AND (reason IS NULL OR trim(reason) = '') THEN 'a reason is required to ' || status || ' a finding' "
    "WHEN id NOT IN (SELECT id FROM store) THEN 'unknown finding' END AS error FROM decisions)"
)


@query("triage", q(
    f"{common.STORE}, {_DECISIONS}",
    "SELECT s.id, s.repo_id, CASE WHEN j.id IS NOT NULL THEN j.status ELSE s.triage_status END AS triage_status, "
    "CASE WHEN j.id IS NOT NULL THEN j.reason END AS triage_reason "
    "FROM store s LEFT JOIN (SELECT * FROM judged WHERE error IS NULL) j ON j.id = s.id",
))
def triage(spark, sf_dir):
    stored = common.store(spark, sf_dir)
    return govern.triage(stored, _decisions(stored)).select("id", "repo_id", "triage_status", "triage_reason")


@query("bulk_result", q(
    f"{common.STORE}, {_DECISIONS}",
    "SELECT category, count(*) AS total, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed "
    "FROM judged GROUP BY category",
))
def bulk_result(spark, sf_dir):
    stored = common.store(spark, sf_dir)
    return govern.bulk_result(govern.judge_decisions(stored, _decisions(stored)), "category")


@query("bulk_failures", q(f"{common.STORE}, {_DECISIONS}", "SELECT id, error FROM judged WHERE error IS NOT NULL"))
def bulk_failures(spark, sf_dir):
    stored = common.store(spark, sf_dir)
    return govern.bulk_failures(govern.judge_decisions(stored, _decisions(stored)))


@query("triage_audit", q(
    f"{common.STORE}, {_DECISIONS}",
    "SELECT CASE WHEN actor = '' THEN 'system' ELSE actor END AS actor, 'finding.triage' AS action, id AS target, "
    f"'status=' || status || CASE WHEN reason IS NULL THEN '' ELSE ', reason set' END AS detail, {common.NOW}::BIGINT AS at "
    "FROM judged WHERE error IS NULL",
))
def triage_audit(spark, sf_dir):
    stored = common.store(spark, sf_dir)
    accepted = govern.judge_decisions(stored, _decisions(stored)).filter("error IS NULL")
    return plain(govern.triage_audit(accepted, F.timestamp_seconds(F.lit(common.NOW))))


@query("triage_merge_on_read", q(
    f"{common.STORE}, {_DECISIONS}, {common.REPOSITORIES}, done AS (SELECT s.* REPLACE (CASE WHEN j.id IS NOT NULL THEN j.status ELSE s.triage_status END AS triage_status, "
    "CASE WHEN j.id IS NOT NULL THEN j.reason END AS triage_reason) FROM store s LEFT JOIN (SELECT * FROM judged WHERE error IS NULL) j ON j.id = s.id)",
    "SELECT id, repo_id, triage_status, triage_reason, CASE WHEN category = 'SECRET' AND triage_status = 'OPEN' AND repo_id IN "
    "(SELECT name FROM repos WHERE remediation_enabled) THEN 'SCRUBBED' ELSE remediation_status END AS remediation_status FROM done",
))
def triage_merge_on_read(spark, sf_dir):
    """A store with a log of two batches, triage and the marks of a scrub, merged when it is read."""
    stored, path = materialise(common.store(spark, sf_dir), "store"), work_dir(spark, "decisions")
    dl.append(dl.triage_rows(stored, _decisions(stored)), path, 0)
    done = corpora.repositories(spark, sf_dir).filter("remediation_enabled").select(F.col("name").alias("repo_id"))
    dl.append(dl.scrub_rows(stored, dl.read_log(spark, path), done, 2), path, 1)
    now = dl.current(stored, dl.read_log(spark, path))
    return now.select("id", "repo_id", "triage_status", "triage_reason", "remediation_status")


@query("recent_audit", q(
    f"{common.STORE}, {_DECISIONS}",
    "SELECT target, detail, \"at\" FROM (SELECT s.id AS target, 'status=' || j.status || CASE WHEN reason IS NULL THEN '' ELSE ', reason set' END AS detail, s.last_seen AS \"at\" "
    "FROM judged j JOIN store s USING (id) WHERE error IS NULL) ORDER BY \"at\" DESC, target LIMIT 20",
))
def recent_audit(spark, sf_dir):
    from veilscan.operators import query as qo

    stored = common.store(spark, sf_dir)
    accepted = govern.judge_decisions(stored, _decisions(stored)).filter("error IS NULL")
    dated = accepted.join(stored.select("id", "last_seen"), "id")
    return plain(qo.recent_audit(govern.triage_audit(dated, F.col("last_seen")), 20), "target", "detail", "at")


@query("retention", q(
    common.AGG, f"SELECT repo_id, fingerprint, last_seen FROM agg WHERE last_seen >= {common.NOW - 28 * 86400}",
))
def retention(spark, sf_dir):
    kept = govern.retention(common.aggregated(spark, sf_dir), F.timestamp_seconds(F.lit(common.NOW)), 28)
    return plain(kept, "repo_id", "fingerprint", "last_seen")


# --- remediation --------------------------------------------------------------------

@query("scrub_dry_run", q(
    common.STORE,
    "SELECT repo_id, count(*) FILTER (category = 'SECRET' AND triage_status = 'OPEN') AS affected FROM store GROUP BY repo_id",
))
def scrub_dry_run(spark, sf_dir):
    return govern.scrub_dry_run(common.store(spark, sf_dir))


@query("scrub_report_lines", q(
    common.STORE,
    "SELECT repo_id, fingerprint, '- ' || path || ':' || line_no || ' — ' || redacted_match || ' (fp ' || left(fingerprint, 12) || ')' AS report_line "
    "FROM store WHERE category = 'SECRET' AND triage_status = 'OPEN'",
))
def scrub_report_lines(spark, sf_dir):
    return govern.scrub_report_lines(common.store(spark, sf_dir))


@query("scrub_decision", q(
    f"{common.STORE}, {common.REPOSITORIES}, active AS (SELECT repo_id, bool_or(category = 'SECRET' AND triage_status = 'OPEN' AND severity = 'CRITICAL') AS a FROM store GROUP BY repo_id), "
    "gates AS (SELECT name AS repo_id, CASE WHEN NOT remediation_enabled THEN 'OPT_IN' WHEN coalesce(a, false) AND n % 2 = 0 THEN 'ROTATION' "
    "WHEN n % 5 = 0 THEN 'DRY_RUN' WHEN n % 7 = 0 THEN 'FORCE_PUSH' WHEN n % 11 = 0 THEN 'TOOL' END AS blocking_gate FROM repos LEFT JOIN active ON repo_id = name)",
    "SELECT repo_id, blocking_gate, blocking_gate IS NULL AS allowed FROM gates",
))
def scrub_decision(spark, sf_dir):
    stored = common.store(spark, sf_dir).withColumn("verified", F.col("severity") == "CRITICAL")
    n = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    states = (
        corpora.repositories(spark, sf_dir)
        .withColumn("repo_id", F.col("name"))
        .join(govern.active_secrets(stored), "repo_id", "left")
        .select(
            "repo_id",
            F.col("remediation_enabled").alias("repo_enabled"),
            F.coalesce("active_secret", F.lit(False)).alias("active_secret"),
            (n % 2 != 0).alias("rotation_confirmed"),
            (n % 5 != 0).alias("dry_run_completed"),
            (n % 7 != 0).alias("force_push_approved"),
            (n % 11 != 0).alias("tool_available"),
        )
    )
    return govern.scrub_decision(states).select("repo_id", "blocking_gate", "allowed")


_OPTED = "opted AS (SELECT name AS repo_id, location, CASE WHEN len(branches) > 0 THEN branches[1] ELSE 'main' END AS base_branch FROM repos WHERE remediation_enabled)"


@query("remediation_targets", q(
    f"{common.STORE}, {common.REPOSITORIES}, {_OPTED}",
    "SELECT repo_id, id, location, base_branch FROM store JOIN opted USING (repo_id) WHERE category = 'SECRET' AND remediation_status = 'OPEN'",
))
def remediation_targets(spark, sf_dir):
    repos = corpora.repositories(spark, sf_dir)
    return govern.remediation_targets(common.store(spark, sf_dir), repos).select(
        "repo_id", "id", "location", "base_branch"
    )


@query("mark_scrubbed", q(
    f"{common.STORE}, {common.REPOSITORIES}",
    "SELECT id, CASE WHEN category = 'SECRET' AND triage_status = 'OPEN' AND repo_id IN (SELECT name FROM repos WHERE remediation_enabled) THEN 'SCRUBBED' ELSE remediation_status END AS remediation_status FROM store",
))
def mark_scrubbed(spark, sf_dir):
    done = corpora.repositories(spark, sf_dir).filter("remediation_enabled").select(F.col("name").alias("repo_id"))
    return govern.mark_scrubbed(common.store(spark, sf_dir), done).select("id", "remediation_status")


_PROPOSALS = (
    "proposed AS (SELECT id AS finding_id, repo_id, path, line_no, rule_id, CASE WHEN triage_status = 'FALSE_POSITIVE' THEN 'ANNOTATE' "
    "WHEN rule_id = 'private-key' THEN 'REMOVE_LINE' ELSE 'REDACT' END AS strategy, "
    "CASE WHEN rule_id = 'generic-api-key' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM store WHERE category = 'SECRET')"
)


@query("fix_proposals", q(
    f"{common.STORE}, {_PROPOSALS}",
    "SELECT finding_id, path, line_no AS start_line, strategy, confidence, CASE strategy WHEN 'REMOVE_LINE' THEN '' ELSE '***REMOVED***' END AS new_content FROM proposed",
))
def fix_proposals(spark, sf_dir):
    return govern.proposals(common.store(spark, sf_dir)).select(
        "finding_id", "path", "start_line", "strategy", "confidence", "new_content"
    )


@query("plan_fixes", q(
    f"{common.STORE}, {_PROPOSALS}",
    "SELECT repo_id, path, count(*) AS edits, NOT bool_and(confidence = 'HIGH') AS review_required FROM proposed GROUP BY repo_id, path",
))
def plan_fixes(spark, sf_dir):
    return govern.plan_fixes(govern.proposals(common.store(spark, sf_dir)), "repo_id", "path", auto=True)


@query("plan_summary_lines", q(
    f"{common.STORE}, {_PROPOSALS}",
    "SELECT repo_id, path, '- ' || strategy || ': fix ' || rule_id AS summary_line FROM proposed",
))
def plan_summary_lines(spark, sf_dir):
    return govern.plan_summary_lines(govern.proposals(common.store(spark, sf_dir)), "repo_id", "path")


def _edits(units):
    """Three edits per file: replace the first line, annotate the second, cut the
    third and fourth."""
    edits = ((1, 1, 1, fv.REMOVED_MARK), (2, 2, 2, fv.APPEND_MARK + " # scanner:ignore-line "), (3, 3, 4, "-"))
    kind = "struct<seq:int,start_line:int,end_line:int,new_content:string>"
    rows = F.array(*[F.struct(*[F.lit(v) for v in e]).cast(kind) for e in edits])
    return units.select("repo_id", "path", F.inline(rows))


@query("apply_edits", q(
    f"units AS ({sql.PLANTED}), cut AS (SELECT repo_id, path, string_split(regexp_replace(content, '\\r?\\n$', ''), chr(10)) AS l FROM units), "
    "e1 AS (SELECT repo_id, path, list_concat(['***REMOVED***'], l[2:]) AS l FROM cut), "
    "e2 AS (SELECT repo_id, path, CASE WHEN len(l) >= 2 AND NOT contains(l[2], 'scanner:ignore-') THEN list_concat(list_concat(l[:1], [l[2] || ' # scanner:ignore-line']), l[3:]) ELSE l END AS l FROM e1), "
    "e3 AS (SELECT repo_id, path, CASE WHEN len(l) >= 2 THEN list_concat(list_concat(l[:2], ['-']), l[5:]) ELSE l END AS l FROM e2)",
    "SELECT repo_id, path, sha256(array_to_string(l, chr(10)) || chr(10)) AS digest, len(l)::INTEGER AS n_lines FROM e3",
))
def apply_edits(spark, sf_dir):
    units = corpora.planted_units(spark, sf_dir)
    done = govern.apply_edits(units, _edits(units))
    return done.select(
        "repo_id", "path", F.sha2("content", 256).alias("digest"),
        (F.size(F.split("content", "\n", -1)) - 1).alias("n_lines"),
    )


SCRUB = ScanConfig(groups=("secrets",), entropy=EntropyConfig(threshold=4.0))


def _scrub_store(spark, sf_dir):
    """Secrets of the repositories that may be rewritten; some are suppressed by their path, some
    were judged false positives."""
    chosen = corpora.repositories(spark, sf_dir).filter("remediation_enabled").select(F.col("name").alias("repo_id"))
    found = fo.aggregate_findings(detect(common.history(spark, sf_dir), SCRUB))
    flagged = fo.apply_path_rules(keep_known(found, chosen, ["repo_id"]), common.SUPPRESSIONS)
    judged = F.when(F.col("fingerprint").startswith("0"), F.lit("FALSE_POSITIVE")).otherwise(F.col("triage_status"))
    return materialise(govern.stored_findings(flagged, F.lit("scan")).withColumn("triage_status", judged), "store")


def _scrub_places() -> str:
    """Every match of a secret rule with the character at which it begins."""
    rules = [(r.rule_id, r.pattern, "true") for r in SCRUB.secret_rules]
    e = SCRUB.entropy
    rules.append((fv.ENTROPY_RULE, fv.ENTROPY_TOKEN, f"length(m) >= {e.min_length} AND {sql.entropy('m')} >= {e.threshold}"))
    lengths = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return " UNION ALL ".join(
        f"SELECT *, 'SECRET' AS category, {sql.lit(rule_id)} AS rule_id FROM (SELECT *, ms[j] AS m, "
        f"({lengths.format('ps[:j]')} + {lengths.format('ms[:j - 1]')} + 1)::BIGINT AS s "
        "FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM (SELECT *, "
        f"regexp_extract_all(line, {sql.lit(pattern)}) AS ms, string_split_regex(line, {sql.lit(pattern)}) AS ps "
        f"FROM lines WHERE regexp_matches(line, {sql.lit(pattern)})))) WHERE {accept}"
        for rule_id, pattern, accept in rules
    )


_LINE = "repo_id, path, commit_id, line_no"
_OPEN_SECRETS = (
    f"{sql.findings_ctes(common.HISTORY, SCRUB)}, {sql.aggregate_ctes()}, {common.REPOSITORIES}, "
    f"open_secrets AS (SELECT DISTINCT repo_id, fingerprint FROM agg WHERE NOT {common.SUPPRESSED_SQL} "
    "AND NOT starts_with(fingerprint, '0') AND repo_id IN (SELECT name FROM repos WHERE remediation_enabled))"
)
_SCRUBBED = (
    f"{_OPEN_SECRETS}, places AS ({_scrub_places()}), "
    f"gone AS (SELECT DISTINCT {_LINE}, line, s, s + length(m) AS e FROM (SELECT *, {sql.FINGERPRINT} AS fingerprint "
    f"FROM (SELECT *, {sql.REDACT} AS redacted_match FROM places WHERE NOT {sql.suppressed()})) "
    "SEMI JOIN open_secrets USING (repo_id, fingerprint)), "
    f"apart AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY {_LINE} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM gone), "
    f"numbered_runs AS (SELECT *, sum(begins) OVER (PARTITION BY {_LINE} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW) AS run FROM apart), "
    f"runs AS (SELECT {_LINE}, run, any_value(line) AS line, min(s) AS s, max(e) AS e FROM numbered_runs GROUP BY {_LINE}, run), "
    f"pieces AS (SELECT *, lag(e, 1, 1) OVER (PARTITION BY {_LINE} ORDER BY s) AS since FROM runs), "
    f"changed AS (SELECT {_LINE}, string_agg(substr(line, since, s - since) || '***REMOVED***', '' ORDER BY s) "
    f"|| substr(any_value(line), max(e)) AS clean FROM pieces GROUP BY {_LINE}), "
    "scrubbed AS (SELECT repo_id, path, commit_id, string_agg(coalesce(clean, line), chr(10) ORDER BY line_no) AS content "
    f"FROM lines LEFT JOIN changed USING ({_LINE}) GROUP BY repo_id, path, commit_id)"
)


@query("scrub_content", q(_SCRUBBED, "SELECT repo_id, path, commit_id, sha256(content) AS digest FROM scrubbed"))
def scrub_history(spark, sf_dir):
    done = scrub_content(common.history(spark, sf_dir), _scrub_store(spark, sf_dir), SCRUB)
    return done.select("repo_id", "path", "commit_id", F.sha2("content", 256).alias("digest"))


@query("scrub_remaining", q(_OPEN_SECRETS, "SELECT DISTINCT repo_id, 0::BIGINT AS remaining FROM open_secrets"))
def scrub_remaining(spark, sf_dir):
    """Re-scan after the scrub: nothing is left of the open findings."""
    stored, units = _scrub_store(spark, sf_dir), common.history(spark, sf_dir)
    return remaining_open(scrub_content(units, stored, SCRUB), stored, SCRUB)


_RESCANNED = (
    f"WITH {_SCRUBBED} SELECT s.repo_id, s.path, s.commit_id, u.author, u.ts, s.content "
    "FROM scrubbed s JOIN units u USING (repo_id, path, commit_id)"
)


@query("scrub_left", q(sql.findings_ctes(_RESCANNED, SCRUB), "SELECT repo_id, count(*) AS remaining FROM raw GROUP BY repo_id"))
def scrub_left(spark, sf_dir):
    """Re-scan after the scrub: suppressed secrets, false positives and other repositories' stay."""
    stored = _scrub_store(spark, sf_dir)
    return remaining_secrets(scrub_content(common.history(spark, sf_dir), stored, SCRUB), SCRUB)
