"""Stored findings, accepted baselines and ingested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilscan.functions import text
from veilscan.session import materialise

BASELINE_SCHEMA = (
    "version int, generatedAt string, entries array<struct<fingerprint:string,"
    "acceptedBy:string,acceptedAt:string,reason:string>>"
)
ENTRIES_PER_DOCUMENT = 5000

INGEST_SCHEMA = (
    "repoId string, mode string, status string, ci struct<runRef:string,pipelineUrl:string,"
    "commit:string,branch:string,actor:string>, findings array<struct<detectorId:string,"
    "category:string,severity:string,ruleId:string,file:string,line:int,redactedMatch:string,"
    "fingerprint:string,verified:boolean>>"
)


def append_findings(stored: DataFrame, path: str) -> None:
    """Append to the store. Rows are rebalanced by repository first: small ones share
    a file, and a repository that holds most of the rows is written by many tasks."""
    rebalanced = stored.hint("rebalance", "repo_id")
    rebalanced.write.partitionBy("repo_id").mode("append").parquet(path)


def chunk_of(key: Column, total: int, size: int) -> Column:
    """A stable chunk number so that each chunk holds about ``size`` rows."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-total // size))))


def baseline_documents(entries: DataFrame, generated_at: str, total: int) -> DataFrame:
    """Baseline JSON documents of a bounded number of entries each."""
    entry = F.struct(
        "fingerprint",
        F.col("accepted_by").alias("acceptedBy"),
        F.col("accepted_at").alias("acceptedAt"),
        "reason",
    )
    return (
        entries.groupBy(chunk_of(F.col("fingerprint"), total, ENTRIES_PER_DOCUMENT).alias("chunk"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(F.lit(1).alias("version"), F.lit(generated_at).alias("generatedAt"), "entries")
    )


def write_baseline(entries: DataFrame, path: str, generated_at: str) -> None:
    """Written by chunks; the entries are computed once, then counted."""
    entries = materialise(entries, "baseline-entries")
    baseline_documents(entries, generated_at, entries.count()).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one baseline document, pretty-printed or not, or of a folder of
    documents one per line."""
    documents = spark.read.schema(BASELINE_SCHEMA).option("multiLine", "true").json(path)
    if not path.endswith(".json"):
        documents = spark.read.schema(BASELINE_SCHEMA).json(path)
    return baseline_entries(documents)


def baseline_entries(documents: DataFrame) -> DataFrame:
    return documents.select("version", "generatedAt", F.explode("entries").alias("e")).select(
        F.coalesce("version", F.lit(1)).alias("version"),
        F.col("generatedAt").alias("generated_at"),
        "e.fingerprint",
        F.col("e.acceptedBy").alias("accepted_by"),
        F.col("e.acceptedAt").alias("accepted_at"),
        "e.reason",
    )


def parse_ingest(feed: DataFrame, body: Column) -> DataFrame:
    """CI results as (run key, repo, …, findings): the latest body per run reference
    replaces earlier ones. ``feed`` has ``seq`` to tell which is latest; a body without
    run reference is a run of its own."""
    parsed = feed.select("seq", F.from_json(body, INGEST_SCHEMA).alias("r")).filter(
        F.col("r.repoId").rlike(r"\S")
    )
    run_ref = text.blank_to_null(F.col("r.ci.runRef"))
    keyed = parsed.withColumn(
        "scan_id",
        F.coalesce(
            F.sha2(F.concat(F.lit("run/"), run_ref), 256),
            F.sha2(F.concat(F.lit("seq/"), F.col("seq")), 256),
        ),
    )
    latest = keyed.groupBy("scan_id").agg(F.max_by("r", "seq").alias("r"))
    return latest.select(
        "scan_id",
        F.col("r.repoId").alias("repo_id"),
        F.coalesce(text.blank_to_null(F.col("r.mode")), F.lit("diff")).alias("mode"),
        F.coalesce("r.status", F.lit("COMPLETED")).alias("status"),
        F.struct(
            *[
                text.blank_to_null(F.col(f"r.ci.{source}")).alias(name)
                for source, name in (
                    ("runRef", "run_ref"), ("pipelineUrl", "pipeline_url"),
                    ("commit", "commit"), ("branch", "branch"), ("actor", "actor"),
                )
            ]
        ).alias("ci"),
        F.coalesce("r.findings", F.array().cast("array<struct<detectorId:string,category:string,"
                   "severity:string,ruleId:string,file:string,line:int,redactedMatch:string,"
                   "fingerprint:string,verified:boolean>>")).alias("findings"),
    )


def ingested_records(runs: DataFrame) -> DataFrame:
    return runs.select(
        "scan_id", "repo_id", "mode", "status", F.size("findings").alias("finding_count"), "ci"
    )


def ingested_findings(runs: DataFrame) -> DataFrame:
    """Findings of ingested runs with their defaults; rows without rule or match are
    not accepted."""
    f = F.col("f")
    default_print = F.concat_ws(":", F.col("repo_id"), f["ruleId"], f["file"], f["line"].cast("string"))
    return (
        runs.select("scan_id", "repo_id", F.explode("findings").alias("f"))
        .filter(f["ruleId"].rlike(r"\S") & f["redactedMatch"].isNotNull())
        .select(
            "scan_id",
            "repo_id",
            f["detectorId"].alias("detector_id"),
            F.coalesce(f["category"], F.lit("SECRET")).alias("category"),
            F.coalesce(f["severity"], F.lit("MEDIUM")).alias("severity"),
            f["ruleId"].alias("rule_id"),
            f["file"].alias("path"),
            f["line"].alias("line_no"),
            f["redactedMatch"].alias("redacted_match"),
            F.coalesce(text.blank_to_null(f["fingerprint"]), default_print).alias("fingerprint"),
            F.coalesce(f["verified"], F.lit(False)).alias("verified"),
            F.lit("OPEN").alias("triage_status"),
        )
    )


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch to its own partition. A batch that is run again after a
    failure replaces that partition, so nothing counts twice."""
    (
        rows.withColumn("batch_id", F.lit(batch_id))
        .write.option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .mode("overwrite")
        .parquet(path)
    )


def ingested_runs(spark: SparkSession, path: str) -> DataFrame:
    """The latest delivery of every run, over all batches written so far. A run that
    is delivered again replaces the earlier one here, without rewriting anything."""
    return parse_ingest(spark.read.parquet(path), F.col("body"))
