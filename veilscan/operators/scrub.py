"""Removing the secrets of open findings from all history rows, and checking that none remains.

A scrub is directed by findings, not by rules: a match goes if its fingerprint is that of an open
secret of its repository. What was suppressed, accepted or judged a false positive stays, and so
does a match that an inline directive covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilscan.functions import fixed_values as fv, text
from veilscan.functions.patterns import may_match_sql, spark_pattern, sql_text, text_array
from veilscan.operators.detect import ScanConfig, run_detections, secret_detections, suppression_flags
from veilscan.operators.findings import with_fingerprint
from veilscan.operators.govern import open_secret
from veilscan.operators.lookups import lookup_join
from veilscan.operators.values import Membership
from veilscan.session import materialise
from veilscan.sources.units import explode_lines

# Equal contents under one path have the same matches, whatever commit they are from.
FILE = ("repo_id", "path", "digest")


# A fingerprint names rule, path, line and redacted text: its matches stand there and nowhere else.
IN_FILE = "repo_id, path"
IN_LINE = "repo_id, path, cast(line_no as int)"


def _with_digest(units: DataFrame, wanted: Column) -> DataFrame:
    return units.withColumn("digest", F.when(wanted, F.sha2("content", 256)))


def _open(findings: DataFrame) -> DataFrame:
    """The open secrets, once: repo_id, fingerprint, path, line_no."""
    return materialise(findings.filter(open_secret()).select("repo_id", "fingerprint", "path", "line_no").distinct(), "open")


def _files_of(wanted: DataFrame) -> Column:
    """May a unit hold one of the wanted secrets, going by its repository and path? What the filter
    lets through by chance is judged like the rest."""
    return Membership(wanted, IN_FILE).column_test()


def _gaps(pattern: str) -> str:
    """Every match on ``line`` with the number of characters since the match before it."""
    p = sql_text(spark_pattern(pattern))
    return (
        f"filter(transform(arrays_zip(split(line, {p}, -1), regexp_extract_all(line, {p}, 0)), "
        "z -> named_struct('gap', length(z.`0`), 'match', z.`1`)), z -> z.match IS NOT NULL)"
    )


def open_matches(units: DataFrame, findings: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Where the matches of open secrets stand: repo_id, path, digest (of the content), line_no,
    first and after (characters of the line, from 1). ``config`` is that of the scan which found
    them. Only lines in which an open secret was found are searched. Matches leave their task as
    numbers and fingerprints, and once per distinct content."""
    wanted = _open(findings)
    return _places(units, wanted, _files_of(wanted), config)


def _places(units: DataFrame, wanted: DataFrame, in_files: Column, config: ScanConfig) -> DataFrame:
    detections = secret_detections(config)
    found = ", ".join(
        f"CASE WHEN {may_match_sql('line', d.rule)} THEN {_gaps(d.rule.pattern)} END" for d in detections
    )
    # Other units have their content set to null and so give no lines.
    marked = _with_digest(units, in_files).select(*FILE, F.when(in_files, F.col("content")).alias("content"))
    per_rule = (
        explode_lines(marked).filter(Membership(wanted, IN_LINE).column_test())
        .withColumn("off", suppression_flags(config.require_reason))
        .filter("NOT (off.all OR off.secret)")
        .select(*FILE, "line_no", F.posexplode(F.expr(f"array({found})")).alias("rule", "found"))
        .select(*FILE, "line_no", "rule", F.posexplode("found").alias("match_no", "c"))
    )
    accepted = F.lit(True)
    for i, d in enumerate(detections):
        if d.accept is not None:
            accepted = F.when(F.col("rule") == i, d.accept(F.col("c"))).otherwise(accepted)
    rule_id = F.element_at(text_array(d.rule_id for d in detections), F.col("rule") + 1)
    # Rejected matches count as well until places are known.
    matches = with_fingerprint(
        per_rule.select(
            *FILE, "line_no", "rule", "match_no", accepted.alias("accepted"), rule_id.alias("rule_id"),
            (F.col("c.gap") + F.length("c.match")).alias("step"), F.length("c.match").alias("n"),
            text.redact(F.col("c.match")).alias("redacted_match"),
        )
    ).drop("rule_id", "redacted_match").distinct()
    so_far = Window.partitionBy(*FILE, "line_no", "rule").orderBy("match_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = matches.withColumn("after", F.sum("step").over(so_far) + 1).filter("accepted")
    return placed.join(wanted, ["repo_id", "fingerprint"], "left_semi").select(
        *FILE, "line_no", (F.col("after") - F.col("n")).alias("first"), "after"
    )


def _cuts(matches: DataFrame) -> DataFrame:
    """By content: its lines with matches, each with the runs of characters to replace.
    Overlapping matches are one run. The arrays are no longer than the content itself."""
    before = Window.partitionBy(*FILE, "line_no").orderBy("first", "after")
    reach = F.max("after").over(before.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("first") < F.col("reach"), 0).otherwise(1)
    return (
        matches.distinct().withColumn("reach", reach)
        .withColumn("run", F.sum(begins).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*FILE, "line_no", "run").agg(F.min("first").alias("first"), F.max("after").alias("after"))
        .groupBy(*FILE, "line_no").agg(F.array_sort(F.collect_list(F.struct("first", "after"))).alias("runs"))
        .groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("line_no", "runs"))).alias("cuts"))
    )


_MARK = sql_text(fv.REMOVED_MARK)
# One line without its runs, and the lines between two changed ones as they are.
_CLEAN_LINE = (
    "array_join(transform(sequence(0, size(c.runs)), j -> substring(lines[c.line_no - 1], "
    "cast(if(j = 0, 1, c.runs[j - 1].after) as int), "
    "cast(if(j = size(c.runs), length(lines[c.line_no - 1]) + 1, c.runs[j].first) "
    f"- if(j = 0, 1, c.runs[j - 1].after) as int))), {_MARK})"
)
_CLEAN = (
    "array_join(concat(flatten(transform(cuts, (c, i) -> concat("
    "slice(lines, if(i = 0, 0, cuts[i - 1].line_no) + 1, c.line_no - if(i = 0, 0, cuts[i - 1].line_no) - 1), "
    f"array({_CLEAN_LINE})))), "
    "slice(lines, element_at(cuts, -1).line_no + 1, size(lines))), '\\n')"
)


def scrub_content(units: DataFrame, findings: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The units with every match of an open secret of ``findings`` (rows of a finding store)
    replaced, in every commit that holds it; all other text stays as it is.

    Places are found in narrow rows; a content meets its own places by the hash of the content,
    by broadcast as long as they are few. Rows without content, repository or path stay.
    """
    wanted = _open(findings)
    in_files = _files_of(wanted)
    cuts = _cuts(_places(units, wanted, in_files, config))
    marked = lookup_join(_with_digest(units, in_files), cuts, list(FILE), "left")
    lines = F.when(F.col("cuts").isNotNull(), F.split("content", "\n", -1))
    cleaned = F.when(F.col("cuts").isNotNull(), F.expr(_CLEAN)).otherwise(F.col("content"))
    return marked.withColumn("lines", lines).withColumn("content", cleaned).select(*units.columns)


def remaining_secrets(scrubbed: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Re-scan after a scrub: all secret findings left per repository."""
    left = run_detections(scrubbed, secret_detections(config), config.require_reason)
    return left.groupBy("repo_id").agg(F.count("*").alias("remaining"))


def remaining_open(scrubbed: DataFrame, findings: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Re-scan after a scrub: per repository with open secrets, how many of their matches are
    left. A scrub is verified if all are 0. Only files in which they were found can hold them."""
    wanted = _open(findings)
    files = scrubbed.filter(_files_of(wanted))
    left = with_fingerprint(run_detections(files, secret_detections(config), config.require_reason))
    counts = left.join(wanted, ["repo_id", "fingerprint"], "left_semi").groupBy("repo_id").agg(F.count("*").alias("n"))
    return wanted.select("repo_id").distinct().join(counts, "repo_id", "left").select(
        "repo_id", F.coalesce("n", F.lit(0)).alias("remaining")
    )
