"""Rule tables, rulesets and policies, resolved for all repositories at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilscan.functions import fixed_values as fv
from veilscan.functions.fixed_values import Rule
from veilscan.operators.findings import pii_key
from veilscan.operators.lookups import lookup_join

RULESET_SCHEMA = (
    "id string, position int, name string, enforcement string, global boolean, "
    "repo_names array<string>, rules array<struct<rule_id:string, enabled:boolean, "
    "severity:string, match_mode:string, source_name:string>>"
)
POLICY_SCHEMA = (
    "id string, org_unit string, fail_on string, fail_on_new_only boolean, "
    "soft_fail boolean, groups array<string>, warn_threshold string"
)


def rules_table(
    spark: SparkSession,
    secret_rules: Iterable[Rule] = fv.SECRET_RULES,
    iac_rules: Iterable[Rule] = fv.IAC_RULES,
) -> DataFrame:
    """The pattern rules as a dimension table."""
    rows = [
        (r.rule_id, r.description, fv.SECRET_RULES_DETECTOR, "SECRET", r.severity or "MEDIUM", r.pattern, None)
        for r in secret_rules
    ] + [
        (r.rule_id, r.description, fv.IAC_DETECTOR, "IAC", r.severity or "MEDIUM", r.pattern, r.target)
        for r in iac_rules
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, description string, detector_id string, category string, "
        "severity string, regex string, target string",
    )


def rule_catalog(spark: SparkSession) -> DataFrame:
    """Rules of all detectors with default severity and whether they are on. A
    detector without rules of its own is listed by its id."""
    pattern_rules = rules_table(spark).select(
        "rule_id", F.col("rule_id").alias("title"), "detector_id", "category",
        F.col("severity").alias("default_severity"), F.lit(True).alias("default_enabled"),
    )
    others = [
        (r.rule_id, r.rule_id, fv.PII_DETECTOR, "PII", r.severity, r.rule_id not in fv.PII_DEFAULT_OFF)
        for r in fv.PII_RULES
    ] + [
        (fv.ENTROPY_RULE, fv.ENTROPY_RULE, fv.ENTROPY_DETECTOR, "SECRET", "MEDIUM", True),
        (fv.CUSTOM_REGEX_DETECTOR, fv.CUSTOM_REGEX_DETECTOR, fv.CUSTOM_REGEX_DETECTOR, "PII", "MEDIUM", True),
        (fv.VALUES_DETECTOR, fv.VALUES_DETECTOR, fv.VALUES_DETECTOR, "PII", "MEDIUM", True),
    ]
    return pattern_rules.unionByName(spark.createDataFrame(others, pattern_rules.schema))


def pii_allowlist(spark: SparkSession) -> DataFrame:
    """Well-known test accounts and cards as (rule_id, value_key); the key is a hash
    of the normalised value (see findings.pii_key)."""
    rows = [("iban", v) for v in fv.ALLOWED_IBANS] + [("creditcard", v) for v in fv.ALLOWED_CARDS]
    known = spark.createDataFrame(rows, "rule_id string, value string")
    return known.select("rule_id", pii_key(F.col("value"), F.col("rule_id")).alias("value_key"))


def test_email_lists(spark: SparkSession) -> DataFrame:
    """Test and placeholder mail names as (kind, entry)."""
    lists = {
        "address": fv.TEST_MAIL_ADDRESSES,
        "local_part": fv.TEST_MAIL_LOCAL_PARTS,
        "domain": fv.TEST_MAIL_DOMAINS,
        "tld": fv.TEST_MAIL_TLDS,
        "sld": fv.TEST_MAIL_SLDS,
    }
    rows = [(kind, entry) for kind, entries in lists.items() for entry in entries]
    return spark.createDataFrame(rows, "kind string, entry string")


def mail_parts(match: Column) -> Column:
    """The (kind, entry) pairs under which a mail address may be listed."""
    mail = F.lower(match)
    labels = F.split(F.substring_index(mail, "@", -1), r"\.")

    def pairs(kind: str, entries: Column) -> Column:
        return F.transform(
            F.array_distinct(entries), lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entry"))
        )

    return F.concat(
        pairs("address", F.array(mail)),
        pairs("local_part", F.split(F.substring_index(mail, "@", 1), r"[._+-]")),
        pairs("domain", F.array(F.substring_index(mail, "@", -1))),
        pairs("tld", F.array(F.element_at(labels, -1))),
        pairs("sld", F.array(F.get(labels, F.size(labels) - 2))),
    )


def _active_rules(rulesets: DataFrame) -> DataFrame:
    return rulesets.filter(F.col("enforcement") == "ACTIVE").select(
        "position", "global", "repo_names", F.posexplode("rules").alias("index", "rule")
    )


def _latest(rules: DataFrame, *keys: str) -> DataFrame:
    """Later rulesets, and later rules within one, replace earlier ones."""
    return (
        rules.groupBy(*keys, F.col("rule.rule_id").alias("rule_id"))
        .agg(F.max_by("rule", F.struct("position", "index")).alias("rule"))
        .select(
            *keys,
            "rule_id",
            "rule.enabled",
            "rule.severity",
            F.coalesce("rule.match_mode", F.lit("ALWAYS")).alias("match_mode"),
            "rule.source_name",
        )
    )


def global_overrides(rulesets: DataFrame) -> DataFrame:
    return _latest(_active_rules(rulesets).filter("global"))


def repository_overrides(rulesets: DataFrame) -> DataFrame:
    named = _active_rules(rulesets).filter("NOT global").select(
        F.explode("repo_names").alias("repo_id"), "position", "index", "rule"
    )
    return _latest(named, "repo_id")


def resolve_rules(pairs: DataFrame, rulesets: DataFrame) -> DataFrame:
    """``pairs`` (repo_id, rule_id, …) with the override that holds for them: the
    repository's own before the global one; null columns where there is none."""
    fields = ["enabled", "severity", "match_mode", "source_name"]
    own = repository_overrides(rulesets).select(
        "repo_id", "rule_id", F.struct(*fields).alias("_own")
    )
    shared = global_overrides(rulesets).select("rule_id", F.struct(*fields).alias("_shared"))
    joined = lookup_join(pairs, own, ["repo_id", "rule_id"], "left")
    joined = lookup_join(joined, shared, ["rule_id"], "left")
    return joined.withColumn("override", F.coalesce("_own", "_shared")).drop("_own", "_shared")


def apply_overrides(
    findings: DataFrame,
    rulesets: DataFrame,
    default_off: tuple[str, ...] = fv.PII_DEFAULT_OFF,
    named: tuple[str, ...] = (),
) -> DataFrame:
    """Findings as each repository's rulesets want them.

    Detection runs with every rule some repository switches on; here a finding is
    dropped where its rule is off. A pattern finding is also dropped where its rule is off by
    default and neither switched on nor ``named`` by the scan, and where the rule's values are
    matched by list or service instead of pattern: that hands the rule over to the known values,
    whose findings stay. A severity override replaces the severity.
    """
    resolved = resolve_rules(findings, rulesets)
    o = F.col("override")
    by_pattern = F.col("detector_id") == fv.PII_DETECTOR
    quiet = [r for r in default_off if r not in {n.lower() for n in named}]
    on = F.when(o.isNull(), ~(by_pattern & F.col("rule_id").isin(*quiet))).otherwise(
        o["enabled"] & ~(by_pattern & o["match_mode"].isin("LIST", "API"))
    )
    wanted = F.upper(F.trim(o["severity"]))
    severity = F.when(wanted.isin(*fv.SEVERITIES), wanted).otherwise(F.col("severity"))
    return resolved.filter(on).withColumn("severity", severity).select(*findings.columns)


def rules_switched_on(rulesets: DataFrame) -> list[str]:
    """Rules that are off by default but that some ruleset switches on."""
    rows = (
        _active_rules(rulesets)
        .filter(F.col("rule.enabled") & F.col("rule.rule_id").isin(*fv.PII_DEFAULT_OFF))
        .select(F.col("rule.rule_id"))
        .distinct()
        .collect()
    )
    return sorted(r[0] for r in rows)


def _prefixes(org_unit: Column) -> Column:
    """The unit itself and every prefix that ends before a slash."""
    cuts = F.filter(
        F.sequence(F.lit(1), F.length(org_unit) + 1),
        lambda i: (i > F.length(org_unit)) | (F.substr(org_unit, i, F.lit(1)) == "/"),
    )
    return F.transform(cuts, lambda i: F.substr(org_unit, F.lit(1), i - 1))


def resolve_policies(repos: DataFrame, policies: DataFrame) -> DataFrame:
    """``repos`` (repo_id, org_unit) with their policy: the longest unit that is the
    repository's own or a parent of it, else the default, else the fallback.

    Instead of comparing every repository with every policy, each repository lists
    its parents and they meet in an equi-join.
    """
    fields = ["id", "fail_on", "fail_on_new_only", "soft_fail", "groups", "warn_threshold"]
    blank = F.coalesce(~F.col("org_unit").rlike(r"\S"), F.lit(True))
    # Of several policies for the same unit the first one counts, of several defaults
    # the last.
    named = policies.filter(~blank).groupBy(F.col("org_unit").alias("parent")).agg(
        F.min_by(F.struct(*fields), "id").alias("policy")
    )
    default = policies.filter(blank).groupBy().agg(F.max_by(F.struct(*fields), "id").alias("policy"))
    parents = repos.select(
        "repo_id", "org_unit", F.explode(_prefixes(F.coalesce("org_unit", F.lit("")))).alias("parent")
    )
    best = (
        lookup_join(parents, named, ["parent"], "left")
        .groupBy("repo_id", "org_unit")
        .agg(
            F.max_by(
                "policy", F.when(F.col("policy").isNotNull(), F.length("parent"))
            ).alias("policy")
        )
    )
    rows = default.collect()
    fallback = _literal_policy(rows[0]["policy"]) if rows and rows[0]["policy"] else _fallback()
    chosen = F.coalesce(F.col("policy"), fallback)
    return best.select(
        "repo_id",
        "org_unit",
        *[chosen[f].alias("policy_id" if f == "id" else f) for f in fields],
    )


def _fallback() -> Column:
    return F.struct(
        F.lit(None).cast("string").alias("id"),
        F.lit("HIGH").alias("fail_on"),
        F.lit(False).alias("fail_on_new_only"),
        F.lit(False).alias("soft_fail"),
        F.array(F.lit("secrets"), F.lit("pii")).alias("groups"),
        F.lit("MEDIUM").alias("warn_threshold"),
    )


def _literal_policy(policy) -> Column:
    groups = F.array(*[F.lit(g) for g in policy["groups"] or []]).cast("array<string>")
    return F.struct(
        F.lit(policy["id"]).cast("string").alias("id"),
        F.lit(policy["fail_on"]).alias("fail_on"),
        F.lit(policy["fail_on_new_only"]).alias("fail_on_new_only"),
        F.lit(policy["soft_fail"]).alias("soft_fail"),
        groups.alias("groups"),
        F.lit(policy["warn_threshold"]).cast("string").alias("warn_threshold"),
    )
