"""Scanning a whole history when file contents are stored once.

In a full history every commit lists its whole tree, so most files occur in many
commits with the same content. Here the contents (``blob_id``, ``content``) are
scanned once each, whatever number of commits they occur in; the matches, which are
few, then meet the narrow occurrences (``repo_id``, ``path``, ``commit_id``, ``ts``,
``blob_id``). The result is that of scanning every file of every commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilscan.functions import text
from veilscan.operators.detect import (
    FINDING_COLUMNS,
    ScanConfig,
    active_detections,
    empty_findings,
    find_matches,
    in_scope,
)
from veilscan.operators.lookups import lookup_join
from veilscan.session import materialise


def blob_matches(blobs: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Matches of every rule in every content, with the scope a path must have for
    them to count. New contents can be appended to such a table as they arrive."""
    marked = blobs.select(
        "blob_id", text.looks_kubernetes(F.col("content")).alias("kubernetes"), "content"
    )
    found = find_matches(
        marked, active_detections(config), config.require_reason, ("blob_id", "kubernetes"), scoped=False
    )
    # A kubernetes rule counts only in a content that looks like a manifest.
    return found.filter(
        ~F.col("inline_suppressed") & ((F.col("scope") != "kubernetes") | F.col("kubernetes"))
    ).drop("inline_suppressed")


def scan_history(
    occurrences: DataFrame, blobs: DataFrame, config: ScanConfig = ScanConfig()
) -> DataFrame:
    """Raw findings of all occurrences; each content is scanned once."""
    if not active_detections(config):
        return empty_findings(occurrences.sparkSession)
    matches = materialise(blob_matches(blobs, config), "blob-matches")
    target = text.path_target(F.col("path"))
    placed = lookup_join(
        occurrences.select("repo_id", "path", "commit_id", "ts", "blob_id"), matches, ["blob_id"], "inner"
    ).withColumns(
        {
            "file_type": text.file_type(F.col("path")),
            "iac_target": F.when(target == "yaml", F.lit("kubernetes")).otherwise(target),
        }
    )
    counts = F.lit(False)
    for scope in ("any", "text", "terraform", "kubernetes", "dockerfile"):
        counts = F.when(F.col("scope") == scope, F.expr(in_scope(scope))).otherwise(counts)
    return placed.filter(counts).withColumn("verified", F.lit(False)).select(*FINDING_COLUMNS)
