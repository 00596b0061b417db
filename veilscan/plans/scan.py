"""Whole scans: units to aggregated, suppressed, baselined findings and a verdict."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from veilscan.operators import findings as fo, govern, rulesets
from veilscan.operators.detect import ScanConfig, detect
from veilscan.operators.registry import Registry
from veilscan.operators.values import detect_hashed_values, detect_values


@dataclass(frozen=True)
class ScanInputs:
    """Tables that take part in a scan besides the units; all optional."""

    values: DataFrame | None = None
    value_hashes: DataFrame | None = None
    pepper: str = ""
    verifications: DataFrame | None = None
    suppressions: tuple[fo.Suppression, ...] = field(default_factory=tuple)
    baseline: DataFrame | None = None
    rulesets: DataFrame | None = None
    plugins: Registry | None = None


def raw_findings(units: DataFrame, config: ScanConfig, inputs: ScanInputs = ScanInputs()) -> DataFrame:
    """All detectors over the units, with the repositories' rule overrides."""
    return raw_findings_reporting(units, config, inputs)[0]


def raw_findings_reporting(
    units: DataFrame, config: ScanConfig, inputs: ScanInputs = ScanInputs()
) -> tuple[DataFrame, DataFrame]:
    """The findings of all detectors, and the detectors left out (detector_id, message)."""
    failed = units.sparkSession.createDataFrame([], "detector_id string, message string")
    if inputs.rulesets is not None:
        config = config.with_rules_on(tuple(rulesets.rules_switched_on(inputs.rulesets)))
    found = detect(units, config)
    if "pii" in config.groups and inputs.values is not None:
        found = found.unionByName(detect_values(units, inputs.values, require_reason=config.require_reason))
    if "pii" in config.groups and inputs.value_hashes is not None:
        hashed = detect_hashed_values(
            units, inputs.value_hashes, inputs.pepper, require_reason=config.require_reason
        )
        found = found.unionByName(hashed)
    if inputs.plugins is not None:
        own, failed = inputs.plugins.run_reporting(units)
        found = found.unionByName(own)
    if inputs.rulesets is not None:
        found = rulesets.apply_overrides(found, inputs.rulesets, named=config.pii_patterns)
    return found, failed


def scan(
    units: DataFrame, config: ScanConfig = ScanConfig(), inputs: ScanInputs = ScanInputs()
) -> DataFrame:
    """Raw findings → verification → dedup → path suppression → baseline."""
    return scan_reporting(units, config, inputs)[0]


def scan_reporting(
    units: DataFrame, config: ScanConfig = ScanConfig(), inputs: ScanInputs = ScanInputs()
) -> tuple[DataFrame, DataFrame]:
    """The findings of a scan together with its degradations (detector_id, message): detectors
    that failed are left out, the others' findings stand."""
    found, failed = raw_findings_reporting(units, config, inputs)
    if inputs.verifications is not None:
        found = fo.verify_and_escalate(found, inputs.verifications)
    aggregated = fo.apply_path_rules(fo.aggregate_findings(found), inputs.suppressions)
    if inputs.baseline is not None:
        aggregated = fo.apply_baseline(aggregated, inputs.baseline)
    return aggregated, failed


def gate(
    units: DataFrame,
    config: ScanConfig = ScanConfig(),
    inputs: ScanInputs = ScanInputs(),
    fail_on: str = "HIGH",
    fail_on_new_only: bool = False,
    soft_fail: bool = False,
) -> DataFrame:
    """Verdict of every repository that has units, clean ones included."""
    return govern.evaluate_gate(
        scan(units, config, inputs), fail_on, fail_on_new_only, soft_fail, repos=units.select("repo_id")
    )


def scan_under_policies(
    units: DataFrame,
    repos: DataFrame,
    policies: DataFrame,
    config: ScanConfig = ScanConfig(),
    inputs: ScanInputs = ScanInputs(),
) -> DataFrame:
    """Verdict of every repository under its own policy and rulesets, in one job."""
    resolved = rulesets.resolve_policies(repos, policies)
    return govern.evaluate_policy_gate(scan(units, config, inputs), resolved)
