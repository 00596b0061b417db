"""Mergeable sketches of durations and distinct values, kept per key and day.

An increment of scan records or detector runs is read once and stored as one row per key and UTC
day: counts, a KLL sketch of the durations and an HLL sketch of another column's values. Whatever span is asked
for later, only these rows are merged; their size depends on the keys and days, not on the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilscan.operators.metrics import utc_day

# Accuracy of the quantiles: a larger K makes larger sketches and smaller errors.
K = 4000
# A quantile's rank is off by at most this share of the rows, with a certainty of about 99 %.
RANK_ERROR = 2.296 / K**0.9021
# log2 of the slots of a sketch of distinct values: relative standard error 1.04 / sqrt(2^14), under 1 %.
LG_SLOTS = 14


def daily_sketches(
    events: DataFrame, key: str, ts: str, of: str, duration: str = "duration_s", failed: Column | None = None
) -> DataFrame:
    """One row per key and day: runs, failed, durations (KLL) and values of ``of`` (HLL). Null
    durations count as runs and are no part of the sketch."""
    failures = F.lit(0) if failed is None else failed.cast("int")
    return events.groupBy(key, utc_day(F.col(ts)).alias("day")).agg(
        F.count("*").alias("runs"),
        F.sum(failures).cast("bigint").alias("failed"),
        F.kll_sketch_agg_double(F.col(duration).cast("double"), F.lit(K)).alias("durations"),
        F.hll_sketch_agg(of, LG_SLOTS).alias("seen"),
    )


def quantiles(sketches: DataFrame, key: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Runs, error rate, p50 and p95 per key over the days from ``first`` to ``last`` (both
    included; null: open). p50 and p95 are values that occurred, or null where none is known."""
    merged = _between(sketches, first, last).groupBy(key).agg(
        F.sum("runs").alias("runs"), F.sum("failed").alias("failed"), F.kll_merge_agg_double("durations", K).alias("d")
    )

    def at(share: float) -> Column:
        return F.when(F.kll_sketch_get_n_double("d") > 0, F.kll_sketch_get_quantile_double("d", F.lit(share)))

    return merged.select(
        key, "runs", (F.col("failed") / F.col("runs")).alias("error_rate"), at(0.5).alias("p50"), at(0.95).alias("p95")
    )


def distinct_values(sketches: DataFrame, *keys: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """How many values of the sketched column occur in the span, about: per key or, without keys, in all."""
    seen = F.hll_sketch_estimate(F.hll_union_agg("seen", False)).alias("distinct_values")
    return _between(sketches, first, last).groupBy(*keys).agg(seen)


def _between(sketches: DataFrame, first: str | None, last: str | None) -> DataFrame:
    chosen = sketches
    if first is not None:
        chosen = chosen.filter(F.col("day") >= first)
    if last is not None:
        chosen = chosen.filter(F.col("day") <= last)
    return chosen
