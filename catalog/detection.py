"""Detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from catalog.registry import plain, query
from veilscan.functions import checks, fixed_values as fv, text
from veilscan.operators.detect import (
    EntropyConfig,
    FINDING_COLUMNS,
    RuleSwitch,
    ScanConfig,
    active_detections,
    custom_rule,
    detect,
    run_detections,
)
from veilscan.functions.checks import MailFilter
from veilscan.sources import corpora
from veilscan.sources.units import explode_lines

CUSTOMER_ID = custom_rule("customer-id", r"CUST-\d{8}", anchors=("CUST-",))

SECRETS = ScanConfig(groups=("secrets",))
ENTROPY = ScanConfig(groups=("secrets",), secret_rules=(), entropy=EntropyConfig(threshold=3.5))
IBANS = ScanConfig(groups=("pii",), pii_patterns=("iban",))
CARDS = ScanConfig(groups=("pii",), pii_patterns=("creditcard",))
ALL_CARDS = ScanConfig(groups=("pii",), pii_patterns=("creditcard",), allowed_cards=())
MAILS = ScanConfig(
    groups=("pii",), pii_patterns=("email",), mail_filter=MailFilter(domains=("seilerwerk.ch",))
)
ALL_MAILS = ScanConfig(
    groups=("pii",), pii_patterns=("email",), mail_filter=MailFilter(enabled=False)
)
PHONES = ScanConfig(groups=("pii",), pii_patterns=("phone",))
CUSTOM = ScanConfig(groups=("pii",), pii_patterns=("none",), custom_rules=(CUSTOMER_ID,))
IAC = ScanConfig(groups=("iac",))
OVERRIDES = ScanConfig(
    overrides={
        "phone": RuleSwitch(enabled=True, severity="LOW"),
        "creditcard": RuleSwitch(enabled=False),
        "slack-token": RuleSwitch(severity="CRITICAL"),
        "email": RuleSwitch(match_mode="LIST"),
    }
)
FULL = ScanConfig(
    entropy=EntropyConfig(threshold=3.5),
    custom_rules=(CUSTOMER_ID,),
).with_rules_on(("phone",))


def _findings_sql(units: str, config: ScanConfig) -> str:
    return sql.with_query(sql.findings_ctes(units, config), f"SELECT {sql.RAW_COLUMNS} FROM raw")


def _register(name: str, units, units_sql: str, config: ScanConfig) -> None:
    @query(name, _findings_sql(units_sql, config))
    def run(spark, sf_dir, units=units, config=config):
        return plain(detect(units(spark, sf_dir), config), *FINDING_COLUMNS)


_register("detect_secret_rules", corpora.planted_units, sql.PLANTED, SECRETS)
_register("detect_secret_rules_corpus", corpora.all_units, sql.ALL_UNITS, SECRETS)
_register("detect_high_entropy", corpora.planted_units, sql.PLANTED, ENTROPY)
_register("detect_iban", corpora.planted_units, sql.PLANTED, IBANS)
_register("detect_credit_card", corpora.text_units, sql.TEXTS, ALL_CARDS)
_register("detect_credit_card_allowlisted", corpora.planted_units, sql.PLANTED, CARDS)
_register("detect_email", corpora.planted_units, sql.PLANTED, MAILS)
_register("detect_email_unfiltered", corpora.all_units, sql.ALL_UNITS, ALL_MAILS)
_register("detect_phone", corpora.text_units, sql.TEXTS, PHONES)
_register("detect_custom_regex", corpora.planted_units, sql.PLANTED, CUSTOM)
_register("detect_iac", corpora.infrastructure_units, sql.INFRASTRUCTURE, IAC)
_register("scan_with_rule_switches", corpora.planted_units, sql.PLANTED, OVERRIDES)
_register("scan_all_detectors", corpora.all_units, sql.ALL_UNITS, FULL)
_register("scan_planted_all_detectors", corpora.planted_units, sql.PLANTED, FULL)
_register(
    "scan_reason_required",
    corpora.planted_units,
    sql.PLANTED,
    ScanConfig(groups=("secrets", "pii"), require_reason=True),
)


@query(
    "inline_suppressed",
    sql.with_query(
        sql.findings_ctes(sql.PLANTED, ScanConfig()),
        f"SELECT repo_id, path, line_no, category, rule_id, {sql.suppressed()} AS inline_suppressed FROM hits",
    ),
)
def inline_suppressed(spark, sf_dir):
    units = corpora.planted_units(spark, sf_dir)
    found = run_detections(units, active_detections(ScanConfig()), keep_suppressed=True)
    return found.select("repo_id", "path", "line_no", "category", "rule_id", "inline_suppressed")


@query(
    "drop_date_like",
    sql.with_query(
        sql.lines_ctes(sql.PLANTED),
        "SELECT repo_id, path, line_no, m AS match, "
        f"{sql.DATE_LIKE} AS date_like FROM (SELECT *, unnest(regexp_extract_all(line, "
        "'[0-9][0-9./:-]{3,}[0-9]')) AS m FROM lines)",
    ),
)
def drop_date_like(spark, sf_dir):
    lines = explode_lines(corpora.planted_units(spark, sf_dir))
    return lines.select(
        "repo_id", "path", "line_no",
        F.explode(F.regexp_extract_all("line", F.lit("[0-9][0-9./:-]{3,}[0-9]"), F.lit(0))).alias("match"),
    ).withColumn("date_like", checks.date_like(F.col("match")))


@query(
    "card_checks",
    sql.with_query(
        sql.lines_ctes(sql.TEXTS),
        f"SELECT repo_id, path, line_no, {sql.REDACT} AS redacted_match, "
        f"NOT ({sql.CARD_EDGE}) AS touches_hex, {sql.luhn(sql.DIGITS)} AS luhn_ok, "
        f"coalesce({sql.issuer(sql.DIGITS)}, false) AS issuer_ok FROM ({sql.card_source()})",
    ),
)
def card_checks(spark, sf_dir):
    from veilscan.operators.detect import CARD_CANDIDATES

    lines = explode_lines(corpora.text_units(spark, sf_dir)).filter(F.col("line").rlike(r"\d(?:[ -]?\d){12}"))
    found = lines.select("repo_id", "path", "line_no", F.inline(F.expr(CARD_CANDIDATES)))
    match = F.col("match")
    return found.select(
        "repo_id", "path", "line_no",
        text.redact(match).alias("redacted_match"),
        checks.touches_hex_token(F.col("before"), F.col("after")).alias("touches_hex"),
        checks.luhn_valid(match).alias("luhn_ok"),
        checks.issuer_known(text.normalise_pii(match, upper=False)).alias("issuer_ok"),
    )


@query(
    "token_entropy",
    sql.with_query(
        sql.lines_ctes(sql.ALL_UNITS),
        f"SELECT repo_id, path, line_no, {sql.REDACT} AS token, round({sql.entropy('m')}, 6) AS entropy "
        f"FROM (SELECT *, unnest(regexp_extract_all(line, {sql.lit(fv.ENTROPY_TOKEN)})) AS m FROM lines)",
    ),
)
def token_entropy(spark, sf_dir):
    lines = explode_lines(corpora.all_units(spark, sf_dir))
    tokens = lines.select(
        "repo_id", "path", "line_no",
        F.explode(F.regexp_extract_all("line", F.lit(fv.ENTROPY_TOKEN), F.lit(0))).alias("t"),
    )
    return tokens.select(
        "repo_id", "path", "line_no",
        text.redact(F.col("t")).alias("token"),
        F.round(text.shannon_entropy(F.col("t")), 6).alias("entropy"),
    )


@query(
    "join_iban_country",
    sql.with_query(
        sql.lines_ctes(sql.PLANTED)
        + ", countries(country, expected) AS (VALUES "
        + ", ".join(f"('{k}', {v})" for k, v in fv.IBAN_LENGTHS.items())
        + ")",
        "SELECT repo_id, path, line_no, country, expected, n FROM (SELECT repo_id, path, line_no, "
        f"left({sql.IBAN}, 2) AS country, length({sql.IBAN})::INTEGER AS n FROM (SELECT *, unnest(regexp_extract_all(line, {sql.lit(fv.IBAN_PATTERN)})) AS m FROM lines)) "
        "JOIN countries USING (country)",
    ),
)
def join_iban_country(spark, sf_dir):
    from veilscan.functions.patterns import all_matches

    lines = explode_lines(corpora.planted_units(spark, sf_dir))
    found = lines.select(
        "repo_id", "path", "line_no", F.explode(all_matches(F.col("line"), fv.IBAN_PATTERN)).alias("m")
    )
    plain_iban = text.normalise_pii(F.col("m"), upper=True)
    # 72 countries at most, fixed by the registry.
    countries = spark.createDataFrame(list(fv.IBAN_LENGTHS.items()), "country string, expected int")
    return found.select(
        "repo_id", "path", "line_no",
        F.substring(plain_iban, 1, 2).alias("country"),
        F.length(plain_iban).alias("n"),
    ).join(F.broadcast(countries), "country").select(
        "repo_id", "path", "line_no", "country", "expected", "n"
    )
