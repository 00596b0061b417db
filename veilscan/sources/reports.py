"""Report formats: SARIF results and build-log messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilscan.functions import text
from veilscan.functions.text import build_log_escape as esc
from veilscan.operators.lookups import lookup_join

SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
)
TOOL_NAME = "veilscan"
RESULTS_PER_DOCUMENT = 5000


def reportable(findings: DataFrame) -> DataFrame:
    """Reports show what is not suppressed; baseline findings stay in."""
    return findings.filter(~F.col("suppressed"))


def _sarif_result() -> Column:
    location = F.struct(
        F.struct(
            F.struct(F.col("path").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line_no").alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        text.sarif_level(F.col("severity")).alias("level"),
        F.struct(
            F.concat(
                F.lit("Potential "), F.col("category"), F.lit(" finding: "), F.col("redacted_match")
            ).alias("text")
        ).alias("message"),
        F.array(location).alias("locations"),
        F.struct(F.col("fingerprint").alias("scannerFingerprint/v1")).alias("partialFingerprints"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result object per reported finding, as JSON text."""
    return reportable(findings).select(
        "repo_id", "fingerprint", F.to_json(_sarif_result()).alias("result")
    )


def sarif_rules(catalog: DataFrame, descriptions: Column) -> DataFrame:
    return catalog.select(
        F.struct(
            F.col("rule_id").alias("id"),
            F.col("title").alias("name"),
            F.struct(descriptions.alias("text")).alias("shortDescription"),
            F.struct(text.sarif_level(F.col("default_severity")).alias("level")).alias(
                "defaultConfiguration"
            ),
        ).alias("rule")
    )


def sarif_documents(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Whole SARIF logs per repository, each of a bounded number of results: a large
    repository gets several logs instead of one row that no task could hold."""
    rule_list = [r["rule"] for r in rules.select(F.to_json("rule").alias("rule")).collect()]
    shown = reportable(findings)
    counts = shown.groupBy("repo_id").agg(F.count("*").alias("total"))
    chunks = F.greatest(F.ceil(F.col("total") / RESULTS_PER_DOCUMENT), F.lit(1))
    chunked = lookup_join(shown, counts, ["repo_id"], "inner").withColumn(
        "chunk", F.pmod(F.xxhash64("fingerprint"), chunks)
    )
    results = chunked.groupBy("repo_id", "chunk").agg(
        F.array_join(F.array_sort(F.collect_list(F.to_json(_sarif_result()))), ",").alias("results")
    )
    head = (
        f'{{"version":"{SARIF_VERSION}","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":'
        f'{{"name":"{TOOL_NAME}","rules":[{",".join(sorted(rule_list))}]}}}},"results":['
    )
    return results.select(
        "repo_id", "chunk", F.concat(F.lit(head), "results", F.lit("]}]}")).alias("document")
    )


def build_log_messages(findings: DataFrame) -> DataFrame:
    """Service messages: two lines per reported finding."""
    rule = esc(F.col("rule_id"))
    kind = F.concat(
        F.lit("##teamcity[inspectionType id='"), rule, F.lit("' name='"), rule,
        F.lit("' category='secret-scan' description='Secret scan rule']"),
    )
    inspection = F.concat(
        F.lit("##teamcity[inspection typeId='"), rule, F.lit("' message='"),
        esc(F.concat(F.lit("Potential "), F.col("category"), F.lit(": "), F.col("redacted_match"))),
        F.lit("' file='"), esc(F.col("path")), F.lit("' line='"), F.col("line_no"),
        F.lit("' SEVERITY='"), text.build_log_level(F.col("severity")), F.lit("']"),
    )
    return reportable(findings).select(
        "repo_id", "fingerprint", F.posexplode(F.array(kind, inspection)).alias("part", "message")
    )


def build_log_problem(findings: DataFrame) -> DataFrame:
    """The closing problem line; no row when there is no finding."""
    return (
        reportable(findings)
        .agg(F.count("*").alias("n"))
        .filter("n > 0")
        .select(
            F.concat(
                F.lit("##teamcity[buildProblem description='Secret scan: "), F.col("n"),
                F.lit(" finding(s)' identity='secretScan']"),
            ).alias("message")
        )
    )


def write_build_log(findings: DataFrame, path: str) -> None:
    build_log_messages(findings).select("message").write.mode("overwrite").text(path)
    build_log_problem(findings).write.mode("append").text(path)


def write_sarif(findings: DataFrame, rules: DataFrame, path: str) -> None:
    sarif_documents(findings, rules).select("repo_id", F.col("document").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("repo_id").text(path)
