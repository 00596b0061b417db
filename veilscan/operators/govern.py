"""Quality gate, triage, retention, audit and remediation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilscan.functions import fixed_values as fv, text
from veilscan.operators.lookups import keep_known, lookup_join


def countable(fail_on: Column, fail_on_new_only: Column) -> Column:
    """Does an aggregated finding count against the gate?"""
    return (
        ~F.col("suppressed")
        & ~(fail_on_new_only & F.col("baseline"))
        & (text.severity_rank(F.col("severity")) >= text.severity_rank(fail_on))
    )


def _verdict(blocking: DataFrame) -> DataFrame:
    passed = F.col("blocking_count") == 0
    return blocking.withColumn("passed", passed).withColumn(
        "exit_code",
        F.when(passed, 0).when(F.col("soft_fail"), 3).otherwise(1).cast("int"),
    )


def evaluate_gate(
    findings: DataFrame,
    fail_on: str = "HIGH",
    fail_on_new_only: bool = False,
    soft_fail: bool = False,
    warn_threshold: str = "MEDIUM",
    repos: DataFrame | None = None,
) -> DataFrame:
    """Verdict per repository over aggregated findings. ``repos`` (repo_id) names all that were
    scanned: those without any finding pass."""
    new_only = F.lit(fail_on_new_only)
    counted = findings.groupBy("repo_id").agg(
        F.count_if(countable(F.lit(fail_on), new_only)).alias("blocking_count"),
        F.count_if(countable(F.lit(warn_threshold), new_only)).alias("warn_count"),
    )
    counted = _for_all(counted, repos)
    return _verdict(
        counted.withColumns({"fail_on": F.lit(fail_on), "soft_fail": F.lit(soft_fail)})
    )


def _for_all(counted: DataFrame, repos: DataFrame | None) -> DataFrame:
    """Counts for every repository, zero where nothing was found."""
    if repos is None:
        return counted
    return repos.select("repo_id").distinct().join(counted, "repo_id", "left").na.fill(0)


def evaluate_raw_gate(
    findings: DataFrame, fail_on: str = "HIGH", soft_fail: bool = False, repos: DataFrame | None = None
) -> DataFrame:
    """Verdict per repository over raw findings."""
    counted = findings.groupBy("repo_id").agg(
        F.count_if(text.at_least(F.col("severity"), fail_on)).alias("blocking_count")
    )
    counted = _for_all(counted, repos)
    return _verdict(
        counted.withColumns({"fail_on": F.lit(fail_on), "soft_fail": F.lit(soft_fail)})
    )


def evaluate_policy_gate(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Verdict per repository under its own policy (see resolve_policies). Findings
    of detector groups the policy leaves out do not count; repositories without any
    finding pass."""
    enabled = F.array_contains("groups", text.category_group(F.col("category")))
    per_severity = findings.groupBy(
        "repo_id", "category", "severity", "suppressed", "baseline"
    ).agg(F.count("*").alias("n"))
    joined = policies.join(per_severity, "repo_id", "left").withColumn(
        "n", F.when(enabled, F.col("n")).otherwise(F.lit(0))
    )
    counted = joined.groupBy("repo_id", "policy_id", "fail_on", "soft_fail").agg(
        F.sum(
            F.when(countable(F.col("fail_on"), F.col("fail_on_new_only")), F.col("n")).otherwise(0)
        ).alias("blocking_count"),
        F.sum(
            F.when(
                countable(F.col("warn_threshold"), F.col("fail_on_new_only")), F.col("n")
            ).otherwise(0)
        ).alias("warn_count"),
    )
    return _verdict(counted)


def findings_under_policies(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Findings of the detector groups that each repository's policy switches on (see
    resolve_policies); those of repositories without a policy stay."""
    groups = policies.select("repo_id", F.col("groups").alias("_groups"))
    wanted = F.array_contains("_groups", text.category_group(F.col("category")))
    return lookup_join(findings, groups, ["repo_id"], "left").filter(
        F.col("_groups").isNull() | wanted
    ).drop("_groups")


def initial_triage() -> Column:
    return (
        F.when(F.col("suppressed"), F.lit("SUPPRESSED"))
        .when(F.col("baseline"), F.lit("BASELINE"))
        .otherwise(F.lit("OPEN"))
    )


def stored_findings(findings: DataFrame, scan_id: Column) -> DataFrame:
    """Aggregated findings as rows of the finding store."""
    return findings.select(
        F.sha2(F.concat_ws("/", scan_id, F.col("repo_id"), F.col("fingerprint")), 256).alias("id"),
        scan_id.alias("scan_id"),
        "repo_id", "fingerprint", "detector_id", "category", "severity", "severity_rank",
        "rule_id", "path", "line_no", "redacted_match", "verified", "first_seen", "last_seen",
        "occurrences",
        initial_triage().alias("triage_status"),
        F.lit(None).cast("string").alias("triage_reason"),
        F.lit("OPEN").alias("remediation_status"),
    )


def decision_error(status: Column, reason: Column, known: Column) -> Column:
    """Why a triage decision is rejected; null when it is fine."""
    no_reason = F.coalesce(~reason.rlike(r"\S"), F.lit(True))
    return (
        F.when(status.isNull() | ~status.isin(*fv.TRIAGE_STATUSES), F.lit("unknown triage status"))
        .when(
            status.isin("SUPPRESSED", "FALSE_POSITIVE") & no_reason,
            F.concat(F.lit("a reason is required to "), status, F.lit(" a finding")),
        )
        .when(~known, F.lit("unknown finding"))
    )


def judge_decisions(store: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, status, reason, …) with ``error``: null where acceptable."""
    # The store is the large side: the few ids decided on go to it, and those it has come back.
    asked = decisions.select("id").distinct()
    known = keep_known(store.select("id"), asked, ["id"]).distinct().withColumn("_known", F.lit(True))
    joined = decisions.join(known, ["id"], "left")
    found = F.coalesce(F.col("_known"), F.lit(False))
    return joined.withColumn(
        "error", decision_error(F.col("status"), F.col("reason"), found)
    ).drop("_known")


def triage(store: DataFrame, decisions: DataFrame) -> DataFrame:
    """The store after the acceptable decisions; of several for one finding the last
    by ``seq`` holds."""
    accepted = (
        judge_decisions(store, decisions)
        .filter(F.col("error").isNull())
        .groupBy("id")
        .agg(F.max_by(F.struct("status", "reason"), "seq").alias("_d"))
    )
    joined = lookup_join(store, accepted, ["id"], "left")
    return joined.withColumns(
        {
            "triage_status": F.coalesce("_d.status", "triage_status"),
            "triage_reason": F.when(F.col("_d").isNotNull(), F.col("_d.reason")).otherwise(
                F.col("triage_reason")
            ),
        }
    ).drop("_d")


def bulk_result(judged: DataFrame, *keys: str) -> DataFrame:
    """Totals of a bulk action; the failures themselves stay rows (bulk_failures)."""
    return judged.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def bulk_failures(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("error").isNotNull()).select("id", "error")


def audit_rows(
    changes: DataFrame, action: str, target: Column, detail: Column, at: Column, actor: Column
) -> DataFrame:
    """Audit events to append; a blank actor is recorded as ``system``."""
    return changes.select(
        F.coalesce(text.blank_to_null(actor), F.lit("system")).alias("actor"),
        F.lit(action).alias("action"),
        target.alias("target"),
        detail.alias("detail"),
        at.alias("at"),
    )


def triage_audit(accepted: DataFrame, at: Column) -> DataFrame:
    detail = F.concat(
        F.lit("status="),
        F.col("status"),
        F.when(F.col("reason").isNull(), F.lit("")).otherwise(F.lit(", reason set")),
    )
    return audit_rows(accepted, "finding.triage", F.col("id"), detail, at, F.col("actor"))


def retention(findings: DataFrame, now: Column, days: int = 365) -> DataFrame:
    return findings.filter(F.col("last_seen") >= now - F.make_dt_interval(F.lit(days)))


def set_remediation_status(store: DataFrame, condition: Column, status: str) -> DataFrame:
    return store.withColumn(
        "remediation_status",
        F.when(condition, F.lit(status)).otherwise(F.col("remediation_status")),
    )


def open_secret() -> Column:
    return (F.col("category") == "SECRET") & (F.col("triage_status") == "OPEN")


def remediable() -> Column:
    return (F.col("category") == "SECRET") & (F.col("remediation_status") == "OPEN")


def mark_scrubbed(store: DataFrame, scrubbed: DataFrame) -> DataFrame:
    """Open secrets of the scrubbed repositories get the status SCRUBBED."""
    done = scrubbed.select("repo_id").distinct().withColumn("_done", F.lit(True))
    joined = lookup_join(store, done, ["repo_id"], "left")
    hit = F.coalesce(F.col("_done"), F.lit(False)) & open_secret()
    return set_remediation_status(joined, hit, "SCRUBBED").drop("_done")


def scrub_decision(states: DataFrame) -> DataFrame:
    """The first gate that blocks a history rewrite, per repository. ``states`` has
    repo_enabled, active_secret, rotation_confirmed, dry_run_completed,
    force_push_approved and tool_available."""
    gate = (
        F.when(~F.col("repo_enabled"), F.lit("OPT_IN"))
        .when(F.col("active_secret") & ~F.col("rotation_confirmed"), F.lit("ROTATION"))
        .when(~F.col("dry_run_completed"), F.lit("DRY_RUN"))
        .when(~F.col("force_push_approved"), F.lit("FORCE_PUSH"))
        .when(~F.col("tool_available"), F.lit("TOOL"))
    )
    return states.withColumn("blocking_gate", gate).withColumn(
        "allowed", F.col("blocking_gate").isNull()
    )


def active_secrets(store: DataFrame) -> DataFrame:
    """Per repository: is there an open secret that was verified as active?"""
    return store.groupBy("repo_id").agg(
        F.coalesce(F.bool_or(open_secret() & F.col("verified")), F.lit(False)).alias("active_secret")
    )


def scrub_dry_run(store: DataFrame) -> DataFrame:
    """Number of open secrets per repository; the replacement lines stay rows."""
    return store.groupBy("repo_id").agg(F.count_if(open_secret()).alias("affected"))


def scrub_report_lines(store: DataFrame) -> DataFrame:
    return store.filter(open_secret()).select(
        "repo_id",
        "fingerprint",
        F.concat(
            F.lit("- "), F.col("path"), F.lit(":"), F.col("line_no"), F.lit(" — "),
            F.col("redacted_match"), F.lit(" (fp "), F.substring("fingerprint", 1, 12), F.lit(")"),
        ).alias("report_line"),
    )


def proposals(findings: DataFrame) -> DataFrame:
    """Built-in fix proposals: redact an open secret, annotate a false positive,
    remove the line of a private key."""
    strategy = (
        F.when(F.col("triage_status") == "FALSE_POSITIVE", F.lit("ANNOTATE"))
        .when(F.col("rule_id") == "private-key", F.lit("REMOVE_LINE"))
        .otherwise(F.lit("REDACT"))
    )
    content = (
        F.when(
            F.col("strategy") == "ANNOTATE",
            F.concat(F.lit(fv.APPEND_MARK), F.lit("# "), F.lit(fv.DIRECTIVE_MARK + "line")),
        )
        .when(F.col("strategy") == "REMOVE_LINE", F.lit(""))
        .otherwise(F.lit(fv.REMOVED_MARK))
    )
    confidence = F.when(F.col("rule_id") == "generic-api-key", F.lit("MEDIUM")).otherwise(F.lit("HIGH"))
    return (
        findings.filter(F.col("category") == "SECRET")
        .withColumn("strategy", strategy)
        .select(
            F.col("id").alias("finding_id"),
            "repo_id",
            "path",
            F.col("line_no").alias("start_line"),
            F.col("line_no").alias("end_line"),
            content.alias("new_content"),
            "strategy",
            confidence.alias("confidence"),
            F.concat(F.lit("fix "), F.col("rule_id")).alias("summary"),
        )
    )


def plan_fixes(plans: DataFrame, *keys: str, auto: bool = False) -> DataFrame:
    """Per group of proposals: how many edits, whether a review is required. The
    edits and summary lines stay rows, so a group may be of any size."""
    all_high = F.coalesce(F.bool_and(F.col("confidence") == "HIGH"), F.lit(False))
    review = ~all_high if auto else F.lit(True)
    return plans.groupBy(*keys).agg(
        F.count("*").alias("edits"), review.alias("review_required")
    )


def plan_summary_lines(plans: DataFrame, *keys: str) -> DataFrame:
    return plans.filter(F.col("summary").rlike(r"\S")).select(
        *keys, F.concat(F.lit("- "), F.col("strategy"), F.lit(": "), F.col("summary")).alias("summary_line")
    )


def remediation_targets(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Remediable findings of opted-in repositories with the branch to fix."""
    opted = repos.filter("remediation_enabled").select(
        F.col("name").alias("repo_id"),
        "location",
        F.when(F.size("branches") > 0, F.element_at("branches", 1))
        .otherwise(F.lit("main"))
        .alias("base_branch"),
    )
    return lookup_join(findings.filter(remediable()), opted, ["repo_id"], "inner")


def apply_edits(units: DataFrame, edits: DataFrame) -> DataFrame:
    """Files after their edits, in the order of ``seq``.

    An edit replaces the lines start..end by its content (one line), or, for content
    that begins with the append mark, adds it to the line unless a directive is there.
    Edits outside the file are skipped. The edits of one file meet its row as one array.
    """
    per_file = edits.groupBy("repo_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("seq", "start_line", "end_line", "new_content"))).alias("edits")
    )
    joined = lookup_join(units, per_file, ["repo_id", "path"], "inner")
    # A trailing newline ends the last line rather than starting another one.
    body = F.regexp_replace("content", r"\r?\n\z", "")
    lines = F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(
        F.split(body, r"\r\n|\n|\r", -1)
    )

    def step(acc: Column, e: Column) -> Column:
        start = e["start_line"]
        end = F.least(e["end_line"], F.size(acc))
        mark = len(fv.APPEND_MARK)
        suffix = F.trim(F.substr(e["new_content"], F.lit(mark + 1)))
        here = F.get(acc, start - 1)
        appended = F.when(
            (start <= F.size(acc)) & ~here.contains(fv.DIRECTIVE_MARK),
            F.concat(
                F.slice(acc, 1, start - 1),
                F.array(F.concat(here, F.lit(" "), suffix)),
                F.slice(acc, start + 1, F.size(acc)),
            ),
        ).otherwise(acc)
        replaced = F.concat(
            F.slice(acc, 1, start - 1),
            F.array(e["new_content"]),
            F.slice(acc, F.greatest(end, start - 1) + 1, F.size(acc) + 1),
        )
        inside = (start >= 1) & (start <= F.size(acc) + 1)
        return F.when(
            inside,
            F.when(e["new_content"].startswith(fv.APPEND_MARK), appended).otherwise(replaced),
        ).otherwise(acc)

    result = F.aggregate("edits", lines, step)
    return joined.withColumn(
        "content",
        F.when(F.size(result) > 0, F.concat(F.array_join(result, "\n"), F.lit("\n"))).otherwise(F.lit("")),
    ).drop("edits")
