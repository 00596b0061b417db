"""Caller-supplied detectors, verifiers and fix proposers.

A detector is a function from a line table to raw findings, both DataFrames. A detector that
fails while it builds its plan is left out of the scan and reported. For arbitrary Python code
per line there is ``batch_outcomes``: it runs on Arrow batches and reports a line on which the
code fails instead of aborting the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veilscan.functions import fixed_values as fv
from veilscan.functions.patterns import sql_text
from veilscan.operators.detect import FINDING_COLUMNS, covered, empty_findings, suppression_flags
from veilscan.sources.units import explode_lines, with_file_type

LineDetector = Callable[[DataFrame], DataFrame]
Proposer = Callable[[DataFrame], DataFrame]

OUTCOME_SCHEMA = (
    "repo_id string, path string, commit_id string, ts timestamp, line_no int, "
    "severity string, rule_id string, redacted_match string, error string"
)


@dataclass(frozen=True)
class Plugin:
    """A named detector with the file types it reads."""

    detector_id: str
    category: str
    detect: LineDetector
    file_types: tuple[str, ...] = fv.FILE_TYPES


@dataclass
class Registry:
    detectors: dict[str, Plugin] = field(default_factory=dict)
    proposers: dict[str, Proposer] = field(default_factory=dict)
    require_reason: bool = False

    def add(self, plugin: Plugin) -> None:
        if not plugin.detector_id.strip() or plugin.category not in fv.CATEGORIES:
            raise ValueError("a detector needs an id and a known category")
        self.detectors[plugin.detector_id] = plugin

    def add_proposer(self, name: str, proposer: Proposer) -> None:
        self.proposers[name] = proposer

    def lines_for(self, units: DataFrame, plugin: Plugin) -> DataFrame:
        """The lines a detector gets to see: its file types, without those a directive
        covers for its category."""
        typed = with_file_type(units).filter(F.col("file_type").isin(*plugin.file_types))
        lines = explode_lines(
            typed.select("repo_id", "path", "commit_id", "ts", "file_type", "content")
        )
        flagged = lines.withColumn("off", suppression_flags(self.require_reason))
        return flagged.filter(~covered("off", sql_text(plugin.category))).drop("off")

    def run(self, units: DataFrame) -> DataFrame:
        """Findings of all registered detectors."""
        return self.run_reporting(units)[0]

    def run_reporting(self, units: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Findings of all registered detectors, and the detectors left out (detector_id, message)."""
        spark = units.sparkSession
        out, failed = empty_findings(spark), []
        for plugin in self.detectors.values():
            try:
                found = plugin.detect(self.lines_for(units, plugin)).select(*FINDING_COLUMNS)
                out = out.unionByName(found)
            except Exception as error:  # noqa: BLE001 - foreign code must not abort the scan
                failed.append((plugin.detector_id, f"{plugin.detector_id}: {type(error).__name__}: {error}"))
        return out, spark.createDataFrame(failed, "detector_id string, message string")

    def propose(self, findings: DataFrame, base: DataFrame) -> DataFrame:
        """Proposals of all proposers, added to the built-in ones."""
        out = base
        for proposer in self.proposers.values():
            out = out.unionByName(proposer(findings).select(*base.columns))
        return out


LineRule = Callable[[str], Iterable[tuple[str, str, str]]]


def batch_outcomes(lines: DataFrame, rule: LineRule) -> DataFrame:
    """Run Python code on lines. ``rule`` yields (rule id, severity, match) per line.
    Matches are redacted in the worker. A line on which the code fails gives one row
    with ``error`` and no finding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                head = (r.repo_id, r.path, r.commit_id, r.ts, r.line_no)
                try:
                    hits = [(s, i, _redact(m), None) for i, s, m in rule(r.line)]
                except Exception as error:  # noqa: BLE001 - any failure of foreign code degrades
                    hits = [(None, None, None, f"{type(error).__name__}: {error}")]
                rows += [(*head, *h) for h in hits]
            yield pd.DataFrame(
                rows,
                columns=[
                    "repo_id", "path", "commit_id", "ts", "line_no", "severity", "rule_id",
                    "redacted_match", "error",
                ],
            )

    narrow = lines.select("repo_id", "path", "commit_id", "ts", "line_no", "line")
    return narrow.mapInPandas(run, OUTCOME_SCHEMA)


def _redact(match: str) -> str:
    n = len(match)
    return "*" * n if n <= 8 else match[:4] + "*" * (n - 8) + match[-4:]


def outcome_findings(outcomes: DataFrame, detector_id: str, category: str) -> DataFrame:
    return outcomes.filter(F.col("error").isNull()).select(
        "repo_id",
        F.lit(detector_id).alias("detector_id"),
        F.lit(category).alias("category"),
        "severity",
        "rule_id",
        "path",
        "line_no",
        "redacted_match",
        "commit_id",
        "ts",
        F.lit(False).alias("verified"),
    )


def degradations(outcomes: DataFrame, detector_id: str) -> DataFrame:
    """One row per unit on which a detector failed."""
    return (
        outcomes.filter(F.col("error").isNotNull())
        .groupBy("repo_id", "path", "commit_id")
        .agg(F.count("*").alias("failed_lines"), F.min("error").alias("error"))
        .select(
            "repo_id",
            F.concat(
                F.lit(f"{detector_id} on "), F.col("path"), F.lit("@"),
                F.substring("commit_id", 1, 8), F.lit(": error: "), F.col("error"),
            ).alias("message"),
            "failed_lines",
        )
    )
