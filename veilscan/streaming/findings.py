"""Incremental scans, dedup across runs and CI ingest as streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilscan.operators import findings as fo
from veilscan.operators.detect import FINDING_COLUMNS, ScanConfig, active_detections, run_detections
from veilscan.operators.lookups import keep_unknown
from veilscan.session import work_dir
from veilscan.sources import store as st
from veilscan.sources.units import UNIT_KEY

LATENESS = "10 minutes"


FINDING_KEY = ("repo_id", "commit_id", "path", "line_no", "detector_id", "rule_id", "match_no")

Sink = Callable[[DataFrame, int], None]


def scan_batches(units: DataFrame, config: ScanConfig, seen: str, checkpoint: str, sink: Sink):
    """Scan units as they arrive, over all that is available now. A unit is skipped only if an
    earlier batch has brought it, however old its commit is: the narrow keys of all units scanned
    lie below ``seen``, a partition per batch. A unit delivered twice within a batch counts once,
    by its findings. ``sink`` gets the findings of a batch and its number, and must replace what it
    wrote for that number before; a batch run again after a failure then changes nothing."""

    def scan_batch(batch: DataFrame, batch_id: int) -> None:
        known = _seen_before(batch.sparkSession, seen, batch_id)
        fresh = batch if known is None else keep_unknown(batch, known, list(UNIT_KEY))
        found = run_detections(fresh, active_detections(config), config.require_reason, with_match_no=True)
        sink(found.dropDuplicates(list(FINDING_KEY)).select(*FINDING_COLUMNS), batch_id)
        st.write_batch(batch.select(*UNIT_KEY).distinct(), seen, batch_id)

    return (
        units.writeStream.foreachBatch(scan_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _seen_before(spark: SparkSession, seen: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(seen).filter(F.col("batch_id") < batch_id)
    except AnalysisException:  # nothing has been written yet
        return None


def stream_scan(units: DataFrame, config: ScanConfig, path: str, state: str):
    """Write the findings of newly arrived units below ``path``; ``state`` is a folder for the
    stream's checkpoint and the keys of the units seen."""
    return scan_batches(units, config, f"{state}/seen", f"{state}/checkpoint", batch_sink(path, lambda found: found))


def stream_dedup(units: DataFrame, config: ScanConfig, path: str, state: str):
    """The same, written as partial rows per fingerprint (see combine_partials)."""
    return scan_batches(units, config, f"{state}/seen", f"{state}/checkpoint", batch_sink(path, partial_findings))


def partial_findings(findings: DataFrame) -> DataFrame:
    """What one batch knows of each fingerprint: a row that can be combined with
    those of other batches."""
    found = fo.aggregate_findings(findings)
    return found.drop("severity_rank", "suppressed", "baseline")


def combine_partials(partials: DataFrame) -> DataFrame:
    """First and last sighting and occurrences over all batches."""
    first = F.min_by(
        F.struct(
            "detector_id", "category", "severity", "rule_id", "path", "line_no",
            "redacted_match", "verified", "commit_id",
        ),
        F.struct("first_seen", "commit_id", "detector_id", "severity", "verified"),
    )
    return (
        partials.groupBy("repo_id", "fingerprint")
        .agg(
            first.alias("f"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.sum("occurrences").cast("bigint").alias("occurrences"),
        )
        .select("repo_id", "fingerprint", "f.*", "first_seen", "last_seen", "occurrences")
    )


def batch_sink(path: str, shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: every batch has its own partition, and no state grows
    with the number of fingerprints or runs."""
    return lambda batch, batch_id: st.write_batch(shape(batch), path, batch_id)


def start_ingest(feed: DataFrame, body: Column, path: str, checkpoint: str):
    """Run the ingest stream over all that is available now: per batch the deliveries
    as they came; the store's ``ingested_runs`` keeps the latest per run."""
    return (
        feed.select("seq", body.alias("body"))
        .writeStream.foreachBatch(batch_sink(path, lambda batch: batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over all that is available now and read the result."""
    spark = stream.sparkSession
    path = work_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", work_dir(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
