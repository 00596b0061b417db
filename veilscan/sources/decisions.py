"""Decisions on stored findings as a log beside the store, merged when the store is read.

A store is written once per scan. What is decided later (triage, marks of a scrub) is appended as
narrow rows (id, seq, status, reason, remediation), a partition per batch; no stored row is
rewritten. Reading takes the latest status and the latest remediation of each id, combined
map-side, and joins them to the store by id. A status and a remediation are independent: a row
sets one and leaves the other null.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilscan.operators import govern
from veilscan.operators.lookups import keep_known, lookup_join
from veilscan.sources.store import write_batch

LOG_SCHEMA = "id string, seq long, status string, reason string, remediation string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All decisions so far; an empty log where none has been written."""
    try:
        written = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LOG_SCHEMA)
    return written.select(*[F.col(c).cast(t) for c, t in (f.split() for f in LOG_SCHEMA.split(", "))])


def latest(log: DataFrame) -> DataFrame:
    """One row per id: its last triage (null if it has none) and its last remediation. Of equal
    ``seq`` the larger status, then reason, holds, so that a reading does not depend on the order."""
    triaged = F.when(F.col("status").isNotNull(), F.struct("seq", "status", F.coalesce("reason", F.lit("")).alias("by"), "reason"))
    marked = F.when(F.col("remediation").isNotNull(), F.struct("seq", "remediation"))
    return log.groupBy("id").agg(F.max(triaged).alias("_triage"), F.max(marked).alias("_mark"))


def current(store: DataFrame, log: DataFrame) -> DataFrame:
    """The store as the decisions leave it."""
    joined = lookup_join(store, latest(log), ["id"], "left")
    return joined.withColumns(
        {
            "triage_status": F.coalesce("_triage.status", "triage_status"),
            "triage_reason": F.when(F.col("_triage").isNotNull(), F.col("_triage.reason")).otherwise(F.col("triage_reason")),
            "remediation_status": F.coalesce("_mark.remediation", "remediation_status"),
        }
    ).drop("_triage", "_mark")


def triage_rows(store: DataFrame, decisions: DataFrame) -> DataFrame:
    """The log rows of the acceptable decisions (id, status, reason, seq)."""
    accepted = govern.judge_decisions(store, decisions).filter(F.col("error").isNull())
    return accepted.select(
        "id", F.col("seq").cast("long").alias("seq"), "status", "reason", F.lit(None).cast("string").alias("remediation")
    )


def scrub_rows(store: DataFrame, log: DataFrame, scrubbed: DataFrame, seq: int) -> DataFrame:
    """The log rows of a scrub: the secrets of these repositories (repo_id) that are open now."""
    here = current(keep_known(store, scrubbed, ["repo_id"]), log).filter(govern.open_secret())
    return here.select(
        "id", F.lit(seq).cast("long").alias("seq"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("reason"), F.lit("SCRUBBED").alias("remediation"),
    )


def append(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch to the log. A batch that is run again replaces its own partition."""
    write_batch(rows, path, batch_id)


def fold(log: DataFrame) -> DataFrame:
    """The log with one row per id and kind, for a log folder that replaces a long one; the store
    reads the same with either."""
    both = latest(log)
    triaged = both.filter("_triage IS NOT NULL").select("id", "_triage.seq", "_triage.status", "_triage.reason", F.lit(None).cast("string").alias("remediation"))
    marked = both.filter("_mark IS NOT NULL").select(
        "id", "_mark.seq", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("reason"), "_mark.remediation"
    )
    return triaged.unionByName(marked)
