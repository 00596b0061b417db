"""Unit tables: one row per file at one commit, and the lines made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilscan.functions import fixed_values as fv, text
from veilscan.operators.lookups import keep_known, keep_unknown
from veilscan.session import materialise

UNIT_COLUMNS = ("repo_id", "path", "commit_id", "author", "ts", "content")
UNIT_KEY = ("repo_id", "commit_id", "path")


def skip_reason(content: Column, max_bytes: int | None = None, nul_probe: int | None = None) -> Column:
    """Why a unit is left out under the limits given: ``size``, ``binary`` (a NUL among the
    first ``nul_probe`` bytes), or null. Without limits nothing is left out."""
    reason = F.lit(None).cast("string")
    if nul_probe is not None:
        head = F.substring(content.cast("binary"), 1, nul_probe)
        reason = F.when(F.contains(head, F.expr("X'00'")), F.lit("binary"))
    if max_bytes is not None:
        reason = F.when(F.octet_length(content) > max_bytes, F.lit("size")).otherwise(reason)
    return reason


def blob_guard(units: DataFrame, max_bytes: int | None = None, nul_probe: int | None = None) -> DataFrame:
    """Units within the limits; ``skipped_units`` lists the others."""
    if max_bytes is None and nul_probe is None:
        return units
    return units.filter(skip_reason(F.col("content"), max_bytes, nul_probe).isNull())


def skipped_units(units: DataFrame, max_bytes: int | None = None, nul_probe: int | None = None) -> DataFrame:
    """The units that the limits leave out, with the reason."""
    return units.select(
        "repo_id", "path", "commit_id", F.octet_length("content").cast("bigint").alias("bytes"),
        skip_reason(F.col("content"), max_bytes, nul_probe).alias("reason"),
    ).filter(F.col("reason").isNotNull())


def read_files(
    spark: SparkSession,
    path: str,
    repo_id: str,
    commit_id: str,
    max_bytes: int | None = None,
    nul_probe: int | None = fv.NUL_PROBE_BYTES,
) -> DataFrame:
    """A folder of checked-out files as units, without binary files (``nul_probe=None`` keeps
    them). A size limit is applied to the listing, before any file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    root = path.rstrip("/")
    relative = F.regexp_replace(F.col("path"), r"^(?:file:)?/*", "/")
    units = files.select(
        F.lit(repo_id).alias("repo_id"),
        F.substring_index(relative, f"{root}/", -1).alias("path"),
        F.lit(commit_id).alias("commit_id"),
        F.lit("").alias("author"),
        F.col("modificationTime").alias("ts"),
        F.decode("content", "UTF-8").alias("content"),
    )
    return blob_guard(units, nul_probe=nul_probe)


def head_commits(units: DataFrame) -> DataFrame:
    """Newest commit per repository, from the narrow columns only."""
    return units.groupBy("repo_id").agg(
        F.max_by("commit_id", F.struct("ts", "commit_id")).alias("commit_id")
    )


def select_history(
    units: DataFrame,
    mode: str = "FULL",
    heads: DataFrame | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """HEAD: files of the head commit. FULL: every commit once. INCREMENTAL: FULL
    without the commits in ``seen``.

    A unit table holding one row per branch has a ``branch`` column; the branch that
    stands for a commit is then picked from the narrow key columns. Units stay in place as
    long as the commits are few enough to be broadcast; beyond, they are shuffled once with
    all columns given, so give a digest for the content where that is all one needs.
    """
    if mode == "HEAD":
        heads = head_commits(units) if heads is None else heads
        return _once(keep_known(units, heads, ["repo_id", "commit_id"]))
    if mode == "FULL":
        return _once(units)
    if mode == "INCREMENTAL":
        return _once(units if seen is None else skip_seen_commits(units, seen))
    raise ValueError(f"unknown history mode {mode!r}")


def _once(units: DataFrame) -> DataFrame:
    if "branch" not in units.columns:
        return _without_copies(units)
    chosen = units.groupBy("repo_id", "commit_id").agg(F.min("branch").alias("branch"))
    return keep_known(units, chosen, ["repo_id", "commit_id", "branch"]).drop("branch")


def _without_copies(units: DataFrame) -> DataFrame:
    """Each unit once. The copies are found on the narrow key columns; only their content
    is shuffled, as long as their keys are few enough to be broadcast."""
    key = list(UNIT_KEY)
    copied = units.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    copied = materialise(copied, "copies")
    if copied.isEmpty():
        return units
    several = units.join(copied, key, "left_semi").dropDuplicates(key)
    return units.join(copied, key, "left_anti").unionByName(several)


def skip_seen_commits(units: DataFrame, seen: DataFrame) -> DataFrame:
    return keep_unknown(units, seen, ["repo_id", "commit_id"])


def mark_seen(units: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The commit cache after this scan: the old entries and the scanned commits."""
    scanned = units.select("repo_id", "commit_id")
    if seen is not None:
        scanned = seen.select("repo_id", "commit_id").unionByName(scanned)
    return scanned.distinct()


def explode_lines(units: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Numbered lines with their predecessor.

    Each line is paired with the previous one inside the array, so neither a window
    nor the whole array has to travel with the exploded rows.
    """
    keep = [c for c in units.columns if c != "content"]
    pairs = F.arrays_zip(
        F.col("lines").alias("line"),
        F.concat(F.array(F.lit(None).cast("string")), F.col("lines")).alias("prev_line"),
    )
    lines = (
        units.select(*keep, F.split("content", "\n", -1).alias("lines"))
        .select(*keep, F.posexplode(pairs).alias("pos", "pair"))
        .select(
            *keep,
            (F.col("pos") + 1).alias("line_no"),
            F.col("pair.line").alias("line"),
            F.col("pair.prev_line").alias("prev_line"),
        )
        .filter(F.col("line").isNotNull())
    )
    if max_chars is not None:
        lines = lines.filter(F.length("line") <= max_chars)
    return lines


def with_file_type(units: DataFrame) -> DataFrame:
    return units.withColumn("file_type", text.file_type(F.col("path")))


def skipped_lines(units: DataFrame, max_chars: int = fv.MAX_LINE_CHARS) -> DataFrame:
    """Per repository: lines that a length limit would leave out."""
    long_lines = F.size(
        F.filter(F.split("content", "\n", -1), lambda x: F.length(x) > max_chars)
    )
    return units.groupBy("repo_id").agg(
        F.sum(F.size(F.split("content", "\n", -1))).cast("bigint").alias("total_lines"),
        F.sum(long_lines).cast("bigint").alias("skipped_lines"),
    )
