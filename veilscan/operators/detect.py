"""Detection: from unit rows to raw findings in one narrow pass.

Shape of the plan: cheap literal and hint tests drop whole units, then single
lines; the remaining candidate lines run every active rule in one projection, and
its array of hits is exploded once. Matches are redacted inside that projection,
so no plain match reaches a shuffle or a table. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilscan.functions import checks, fixed_values as fv, text
from veilscan.functions.checks import MailFilter
from veilscan.functions.fixed_values import Rule
from veilscan.functions.patterns import (
    all_matches_sql,
    among,
    any_sql,
    may_match_sql,
    spark_pattern,
    sql_text,
    text_array,
    with_context,
)
from veilscan.sources.units import blob_guard, explode_lines

FINDING_COLUMNS = (
    "repo_id", "detector_id", "category", "severity", "rule_id", "path", "line_no",
    "redacted_match", "commit_id", "ts", "verified",
)


@dataclass(frozen=True)
class EntropyConfig:
    threshold: float = fv.ENTROPY_THRESHOLD
    min_length: int = fv.ENTROPY_MIN_LENGTH
    severity: str = "MEDIUM"


@dataclass(frozen=True)
class RuleSwitch:
    """Override of one rule: on/off, severity, and how its values are matched."""

    enabled: bool = True
    severity: str | None = None
    match_mode: str = "ALWAYS"


@dataclass(frozen=True)
class ScanConfig:
    """What to detect. Entropy runs only when configured; phone is off by default."""

    groups: tuple[str, ...] = ("secrets", "pii", "iac")
    secret_rules: tuple[Rule, ...] = fv.SECRET_RULES
    iac_rules: tuple[Rule, ...] = fv.IAC_RULES
    iac_targets: tuple[str, ...] = fv.IAC_TARGETS
    pii_patterns: tuple[str, ...] = ()
    custom_rules: tuple[Rule, ...] = ()
    entropy: EntropyConfig | None = None
    mail_filter: MailFilter = field(default_factory=MailFilter)
    allowed_ibans: tuple[str, ...] = fv.ALLOWED_IBANS
    allowed_cards: tuple[str, ...] = fv.ALLOWED_CARDS
    require_reason: bool = False
    # Limits are off unless set; ``skipped_units`` and ``skipped_lines`` list what they leave out.
    max_blob_bytes: int | None = None
    nul_probe_bytes: int | None = None
    max_line_chars: int | None = None
    overrides: dict[str, RuleSwitch] = field(default_factory=dict)

    def active(self, rule_id: str, default_on: bool = True) -> bool:
        switch = self.overrides.get(rule_id)
        if switch is None:
            return default_on
        return switch.enabled and switch.match_mode == "ALWAYS"

    def severity(self, rule_id: str, default: str) -> str:
        switch = self.overrides.get(rule_id)
        return switch.severity if switch and switch.severity else default

    def with_rules_on(self, rule_ids: tuple[str, ...]) -> ScanConfig:
        """The same scan with further rules switched on (for repository overrides)."""
        more = {r: replace(self.overrides.get(r, RuleSwitch()), enabled=True) for r in rule_ids}
        return replace(self, overrides={**self.overrides, **more})


@dataclass(frozen=True)
class Detection:
    """One rule ready to run. ``scope`` names the files it reads: any, text (not
    binary) or an infrastructure target. ``find`` is the SQL expression for the
    array of candidates in the column ``line``; ``accept`` judges one candidate."""

    detector_id: str
    category: str
    severity: str
    rule: Rule
    scope: str
    find: str
    accept: Callable[[Column], Column] | None = None

    @property
    def rule_id(self) -> str:
        return self.rule.rule_id


def _bare(matches: str) -> str:
    return f"transform({matches}, m -> named_struct('before', '', 'match', m, 'after', ''))"


def _pattern_detection(
    rule: Rule,
    detector_id: str,
    category: str,
    severity: str,
    scope: str,
    accept: Callable[[Column], Column] | None = None,
) -> Detection:
    find = _bare(all_matches_sql("line", rule.pattern))
    return Detection(detector_id, category, severity, rule, scope, find, accept)


# Card-like digit runs with the characters around them.
CARD_CANDIDATES = "transform(arrays_zip({}, {}, {}), {})".format(
    *(
        f"regexp_extract_all(line, {sql_text(with_context(fv.CARD_PATTERN))}, {group})"
        for group in (1, 2, 3)
    ),
    "c -> named_struct('before', c.`0`, 'match', c.`1`, 'after', c.`2`)",
)


def secret_detections(config: ScanConfig) -> list[Detection]:
    out = [
        _pattern_detection(
            rule, fv.SECRET_RULES_DETECTOR, "SECRET", config.severity(rule.rule_id, rule.severity), "any"
        )
        for rule in config.secret_rules
        if config.active(rule.rule_id)
    ]
    if config.entropy is not None and config.active(fv.ENTROPY_RULE):
        out.append(_entropy_detection(config, config.entropy))
    return out


def _entropy_detection(config: ScanConfig, entropy: EntropyConfig) -> Detection:
    # Only where a run begins: otherwise every word is tried again from each letter.
    hint = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{max(16, entropy.min_length)}}}"
    rule = Rule(fv.ENTROPY_RULE, "", fv.ENTROPY_TOKEN, entropy.severity, hint=hint)
    return _pattern_detection(
        rule,
        fv.ENTROPY_DETECTOR,
        "SECRET",
        config.severity(rule.rule_id, rule.severity),
        "any",
        lambda c: (F.length(c["match"]) >= entropy.min_length)
        & (text.shannon_entropy(c["match"]) >= entropy.threshold),
    )


def custom_detections(config: ScanConfig) -> list[Detection]:
    return [
        _pattern_detection(
            rule, fv.CUSTOM_REGEX_DETECTOR, "PII", config.severity(rule.rule_id, rule.severity), "text"
        )
        for rule in config.custom_rules
        if config.active(rule.rule_id)
    ]


def pii_detections(config: ScanConfig) -> list[Detection]:
    wanted = {p.lower() for p in config.pii_patterns}
    checks_of = {
        "iban": lambda c: iban_accepted(c["match"], config.allowed_ibans),
        "creditcard": lambda c: card_accepted(c, config.allowed_cards),
        "email": lambda c: ~config.mail_filter.is_test(c["match"]),
        "phone": lambda c: phone_accepted(c["match"]),
    }
    out = []
    for rule in fv.PII_RULES:
        default_on = rule.rule_id in wanted if wanted else rule.rule_id not in fv.PII_DEFAULT_OFF
        if not config.active(rule.rule_id, default_on):
            continue
        accept = checks_of[rule.rule_id]
        made = _pattern_detection(
            rule,
            fv.PII_DETECTOR,
            "PII",
            config.severity(rule.rule_id, rule.severity),
            "text",
            lambda c, accept=accept: ~checks.date_like(c["match"]) & accept(c),
        )
        out.append(replace(made, find=CARD_CANDIDATES) if rule.rule_id == "creditcard" else made)
    return out


def card_accepted(candidate: Column, allowed: tuple[str, ...] = fv.ALLOWED_CARDS) -> Column:
    match = candidate["match"]
    digits = text.normalise_pii(match, upper=False)
    return (
        ~checks.touches_hex_token(candidate["before"], candidate["after"])
        & checks.luhn_valid(match)
        & checks.several_digits(match)
        & checks.issuer_known(digits)
        & ~among(digits, _normalised(allowed, upper=False))
    )


def iban_accepted(match: Column, allowed: tuple[str, ...] = fv.ALLOWED_IBANS) -> Column:
    plain = text.normalise_pii(match, upper=True)
    return checks.iban_valid(match) & ~among(plain, _normalised(allowed, upper=True))


def phone_accepted(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)


def _normalised(values: tuple[str, ...], upper: bool) -> list[str]:
    plain = ["".join(c for c in v if not c.isspace() and c != "-") for v in values]
    return [v.upper() for v in plain] if upper else plain


def iac_detections(config: ScanConfig) -> list[Detection]:
    """At most one finding per line and rule: the first match."""
    return [
        replace(
            _pattern_detection(
                rule, fv.IAC_DETECTOR, "IAC", config.severity(rule.rule_id, rule.severity), rule.target
            ),
            find=_bare(f"slice({all_matches_sql('line', rule.pattern)}, 1, 1)"),
        )
        for rule in config.iac_rules
        if rule.target in config.iac_targets and config.active(rule.rule_id)
    ]


def active_detections(config: ScanConfig) -> list[Detection]:
    out: list[Detection] = []
    if "secrets" in config.groups:
        out += secret_detections(config)
    if "pii" in config.groups:
        out += pii_detections(config) + custom_detections(config)
    if "iac" in config.groups:
        out += iac_detections(config)
    return out


def in_scope(scope: str) -> str:
    if scope == "any":
        return "true"
    if scope == "text":
        return "file_type <> 'BINARY'"
    return f"iac_target = {sql_text(scope)} AND file_type IN ('CONFIG', 'OTHER')"


def _directive(line: str, names: tuple[str, ...], require_reason: bool) -> str:
    """Is one of the named directives on the line (with a reason, if required)?"""
    pattern = sql_text(fv.DIRECTIVE_PATTERN)
    named = f"d.`0` IN ({', '.join(sql_text(n) for n in names)})"
    fits = named + (f" AND d.`1` rlike {sql_text(chr(92) + 'S')}" if require_reason else "")
    return (
        f"(contains({line}, {sql_text(fv.DIRECTIVE_MARK)}) AND exists(arrays_zip("
        f"regexp_extract_all({line}, {pattern}, 1), regexp_extract_all({line}, {pattern}, 2)), "
        f"d -> {fits}))"
    )


def suppression_flags(require_reason: bool = False) -> Column:
    """What the directives on ``line`` and ``prev_line`` cover: findings of every
    category, secrets, personal data."""
    on_line = _directive("line", ("ignore-line",), require_reason)
    before = _directive("coalesce(prev_line, '')", ("ignore-next-line",), require_reason)
    secret = _directive("line", ("ignore-secret",), require_reason)
    pii = _directive("line", ("ignore-pii",), require_reason)
    return F.expr(f"named_struct('all', {on_line} OR {before}, 'secret', {secret}, 'pii', {pii})")


def covered(flags: str, category: str) -> Column:
    """Do the flags cover findings of the category (an SQL expression)?"""
    return F.expr(
        f"{flags}.all OR ({category} = 'SECRET' AND {flags}.secret) "
        f"OR ({category} = 'PII' AND {flags}.pii)"
    )


UNIT_KEYS = ("repo_id", "path", "commit_id", "ts")


def candidate_lines(
    units: DataFrame,
    detections: list[Detection],
    keys: tuple[str, ...] = UNIT_KEYS,
    scoped: bool = True,
    max_line_chars: int | None = None,
) -> DataFrame:
    """Lines on which at least one rule may match, out of units for which that holds.
    Without ``scoped`` the path is not known yet and every rule is tried."""
    scope_columns = {
        "file_type": text.file_type(F.col("path")),
        "iac_target": text.iac_target(F.col("path"), F.col("content")),
    } if scoped else {}
    marked = units.select(*keys, "content", *[c.alias(n) for n, c in scope_columns.items()])

    def promising(column: str, whole_text: bool) -> Column:
        scopes = {}
        for d in detections:
            scope = in_scope(d.scope) if scoped else "true"
            scopes.setdefault(scope, []).append(may_match_sql(column, d.rule, whole_text))
        return F.expr(any_sql(f"({s} AND {any_sql(t)})" for s, t in scopes.items()))

    # A unit without any candidate has its content set to null and so gives no lines.
    # As a projection this test stays where it is and never slides below a shuffle.
    wanted = F.when(promising("content", True), F.col("content"))
    lines = explode_lines(marked.withColumn("content", wanted), max_line_chars)
    return lines.filter(promising("line", False))


def detect(units: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """All pattern detectors over the units: raw findings, already redacted, without
    those an inline directive covers."""
    detections = active_detections(config)
    if not detections:
        return empty_findings(units.sparkSession)
    guarded = blob_guard(units, config.max_blob_bytes, config.nul_probe_bytes)
    return run_detections(guarded, detections, config.require_reason, max_line_chars=config.max_line_chars)


def run_detections(
    units: DataFrame,
    detections: list[Detection],
    require_reason: bool = False,
    keep_suppressed: bool = False,
    with_match_no: bool = False,
    max_line_chars: int | None = None,
) -> DataFrame:
    """Findings of the detections over the units. With ``keep_suppressed`` those under
    an inline directive stay, marked by ``inline_suppressed``; with ``with_match_no`` a
    finding carries its number among the matches of its rule on the line, which makes
    it unique within its unit."""
    found = find_matches(units, detections, require_reason, max_line_chars=max_line_chars)
    if not keep_suppressed:
        found = found.filter(~F.col("inline_suppressed"))
    extra = ["match_no"] if with_match_no else []
    extra += ["inline_suppressed"] if keep_suppressed else []
    return found.withColumn("verified", F.lit(False)).select(*FINDING_COLUMNS, *extra)


def find_matches(
    units: DataFrame,
    detections: list[Detection],
    require_reason: bool = False,
    keys: tuple[str, ...] = UNIT_KEYS,
    scoped: bool = True,
    max_line_chars: int | None = None,
) -> DataFrame:
    """Candidate lines → candidates of every rule → accepted, redacted matches.

    All steps are narrow and run in one task each: the plain match lives only
    between two operators of the same stage.
    """
    if not detections:
        raise ValueError("no detector is active")

    def guard(d: Detection) -> str:
        scope = in_scope(d.scope) if scoped else "true"
        return f"{scope} AND {may_match_sql('line', d.rule)}"

    found = ", ".join(f"CASE WHEN {guard(d)} THEN {d.find} END" for d in detections)
    per_rule = candidate_lines(units, detections, keys, scoped, max_line_chars).select(
        *keys,
        "line_no",
        suppression_flags(require_reason).alias("off"),
        F.posexplode(F.expr(f"array({found})")).alias("rule", "found"),
    )
    candidates = per_rule.select(
        *keys, "line_no", "off", "rule", F.posexplode("found").alias("match_no", "c")
    )

    def of_rule(value: Callable[[Detection], str]) -> Column:
        return F.element_at(text_array(value(d) for d in detections), F.col("rule") + 1)

    accepted = F.lit(True)
    for i, d in enumerate(detections):
        if d.accept is not None:
            accepted = F.when(F.col("rule") == i, d.accept(F.col("c"))).otherwise(accepted)
    matches = candidates.filter(accepted).select(
        *keys,
        "line_no",
        of_rule(lambda d: d.detector_id).alias("detector_id"),
        of_rule(lambda d: d.category).alias("category"),
        of_rule(lambda d: d.severity).alias("severity"),
        of_rule(lambda d: d.rule_id).alias("rule_id"),
        of_rule(lambda d: d.scope).alias("scope"),
        text.redact(F.col("c.match")).alias("redacted_match"),
        "match_no",
        "off",
    )
    return matches.withColumn("inline_suppressed", covered("off", "category")).drop("off")


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "repo_id string, detector_id string, category string, severity string, "
        "rule_id string, path string, line_no int, redacted_match string, "
        "commit_id string, ts timestamp, verified boolean",
    )


def check_rules(spark: SparkSession, rules: tuple[Rule, ...], needs_target: bool = False) -> None:
    """Reject rules without id or pattern, with an unknown severity or a pattern
    that does not compile."""
    for i, rule in enumerate(rules):
        if not rule.rule_id or not rule.pattern or (needs_target and not rule.target):
            raise ValueError(f"rule {i} needs an id and a pattern" + (" and a target" if needs_target else ""))
        if rule.severity not in fv.SEVERITIES:
            raise ValueError(f"rule {rule.rule_id!r} has an unknown severity {rule.severity!r}")
        try:
            spark.range(1).select(F.lit("").rlike(spark_pattern(rule.pattern))).collect()
        except Exception as error:
            raise ValueError(f"rule {rule.rule_id!r} has an invalid pattern") from error


def custom_rule(
    name: str | None,
    pattern: str | None,
    severity: str | None = None,
    anchors: tuple[str, ...] = (),
) -> Rule:
    """A caller's rule; an unknown or missing severity counts as HIGH. ``anchors`` may
    name literals of which every match holds one, so that other units are skipped."""
    if not name or not pattern:
        raise ValueError("a custom rule needs a name and a pattern")
    wanted = (severity or "HIGH").strip().upper()
    return Rule(name, name, pattern, wanted if wanted in fv.SEVERITIES else "HIGH", anchors=anchors)
