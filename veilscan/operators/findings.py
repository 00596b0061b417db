"""From raw findings to aggregated ones: validation, verification, dedup,
suppression by path, baseline."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from veilscan.functions import fixed_values as fv, text
from veilscan.functions.patterns import glob_pattern, sql_text
from veilscan.operators.lookups import lookup_join


class Suppression(NamedTuple):
    """Accepted paths: a glob, a detector id or group (blank: any), and why."""

    path_glob: str
    detector: str = ""
    reason: str = ""


def is_valid() -> Column:
    """The conditions every raw finding has to meet."""
    return F.coalesce(
        F.col("detector_id").rlike(r"\S")
        & F.col("category").isin(*fv.CATEGORIES)
        & F.col("severity").isin(*fv.SEVERITIES)
        & F.col("rule_id").rlike(r"\S")
        & F.col("path").rlike(r"\S")
        & (F.col("line_no") >= 1)
        & F.col("redacted_match").isNotNull(),
        F.lit(False),
    )


def validate_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows)."""
    return findings.filter(is_valid()), findings.filter(~is_valid())


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn(
        "fingerprint",
        text.fingerprint(F.col("rule_id"), F.col("path"), F.col("line_no"), F.col("redacted_match")),
    )


def verify_and_escalate(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Findings confirmed ACTIVE become CRITICAL and verified; any other result, or
    none, leaves them alone. ``results`` holds (fingerprint, status)."""
    marked = findings if "fingerprint" in findings.columns else with_fingerprint(findings)
    active = (
        results.groupBy("fingerprint")
        .agg(F.max(F.col("status") == "ACTIVE").alias("_active"))
        .filter("_active")
    )
    joined = lookup_join(marked, active, ["fingerprint"], "left")
    confirmed = F.coalesce(F.col("_active"), F.lit(False))
    return joined.withColumns(
        {
            "severity": F.when(confirmed, F.lit("CRITICAL")).otherwise(F.col("severity")),
            "verified": F.col("verified") | confirmed,
        }
    ).drop("_active", *([] if "fingerprint" in findings.columns else ["fingerprint"]))


def aggregate_findings(findings: DataFrame) -> DataFrame:
    """One row per repository and fingerprint. The first occurrence by time, then
    commit, stands for all. Combined map-side, so a fingerprint that recurs in every
    commit is one row per task before the shuffle."""
    marked = with_fingerprint(findings)
    first = F.min_by(
        F.struct(
            "detector_id", "category", "severity", "rule_id", "path", "line_no",
            "redacted_match", "verified", "commit_id",
        ),
        F.struct("ts", "commit_id", "detector_id", "severity", "verified"),
    )
    return (
        marked.groupBy("repo_id", "fingerprint")
        .agg(
            first.alias("f"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.count("*").alias("occurrences"),
        )
        .select(
            "repo_id",
            "fingerprint",
            "f.detector_id",
            "f.category",
            "f.severity",
            text.severity_rank(F.col("f.severity")).alias("severity_rank"),
            "f.rule_id",
            "f.path",
            "f.line_no",
            "f.redacted_match",
            "f.verified",
            "f.commit_id",
            "first_seen",
            "last_seen",
            "occurrences",
            F.lit(False).alias("suppressed"),
            F.lit(False).alias("baseline"),
        )
    )


def path_suppressed(rules: Iterable[Suppression]) -> Column:
    """A condition over path, detector_id and category. Rules for the same detector
    share one combined pattern, so no join is needed."""
    globs: dict[str, list[str]] = {}
    for rule in rules:
        if not rule.path_glob.strip():
            raise ValueError("a suppression needs a path glob")
        globs.setdefault(rule.detector or "", []).append(glob_pattern(rule.path_glob))
    groups = ", ".join(f"'{c}', '{g}'" for c, g in fv.GROUP_OF_CATEGORY.items())
    condition = F.lit(False)
    for detector, patterns in globs.items():
        here = F.col("path").rlike("|".join(patterns))
        if detector.strip():
            fits = f"detector_id = {sql_text(detector)} OR map({groups})[category] = {sql_text(detector)}"
            here = here & F.expr(fits)
        condition = condition | here
    return condition


def apply_path_rules(findings: DataFrame, rules: Iterable[Suppression]) -> DataFrame:
    return findings.withColumn("suppressed", F.col("suppressed") | path_suppressed(rules))


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Flag findings whose fingerprint the baseline has accepted."""
    known = baseline.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    return (
        lookup_join(findings, known, ["fingerprint"], "left")
        .withColumn("baseline", F.col("baseline") | F.coalesce(F.col("_known"), F.lit(False)))
        .drop("_known")
    )


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings the baseline does not know."""
    known = baseline.select("fingerprint").distinct()
    return lookup_join(findings, known, ["fingerprint"], "left_anti")


def generate_baseline(
    findings: DataFrame, accepted_by: str, reason: str, at: str
) -> DataFrame:
    """Every aggregated fingerprint, suppressed ones included, as accepted."""
    return findings.select("fingerprint").distinct().select(
        "fingerprint",
        F.lit(accepted_by).alias("accepted_by"),
        F.lit(at).alias("accepted_at"),
        F.lit(reason).alias("reason"),
    )


def drop_allowlisted(candidates: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Candidates (rule_id, value_key) that are not on the allowlist. Both sides hold
    hashes of the normalised values, so no plain value takes part in the join."""
    return lookup_join(candidates, allowlist.distinct(), ["rule_id", "value_key"], "left_anti")


def pii_key(value: Column, rule_id: Column) -> Column:
    plain = F.when(rule_id == "iban", text.normalise_pii(value, upper=True)).otherwise(
        text.normalise_pii(value, upper=False)
    )
    return F.sha2(plain, 256)
