"""Finding lists, facets, cards and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilscan.functions import fixed_values as fv, text
from veilscan.operators.lookups import lookup_join


def query_findings(
    store: DataFrame,
    repo_id: str | None = None,
    min_severity: str | None = None,
    detector_id: str | None = None,
    status: str | None = None,
    offset: int = 0,
    limit: int = fv.PAGE_LIMIT_DEFAULT,
) -> DataFrame:
    """A page of findings, worst first. All filters apply before the page is cut. A ``limit`` of
    0 or less takes the default page size; any other is honoured."""
    out = store
    if repo_id is not None:
        out = out.filter(F.col("repo_id") == repo_id)
    if detector_id is not None:
        out = out.filter(F.col("detector_id") == detector_id)
    if status is not None:
        out = out.filter(F.col("triage_status") == status)
    if min_severity is not None:
        out = out.filter(text.at_least(F.col("severity"), min_severity))
    size = limit if limit > 0 else fv.PAGE_LIMIT_DEFAULT
    return out.orderBy(F.col("severity_rank").desc(), "id").offset(max(0, offset)).limit(size)


def facet_condition(query: str) -> Column:
    """A search text such as ``is:open severity:high rule:x`` as a condition. The
    first token of each kind counts; open findings are the default."""
    tokens = query.split()

    def value(prefix: str) -> str:
        return next((t[len(prefix):] for t in tokens if t.startswith(prefix)), "")

    is_open = F.col("triage_status") == "OPEN"
    condition = ~is_open if value("is:") == "closed" else is_open
    if value("severity:"):
        condition &= F.lower("severity") == value("severity:")
    if value("detector:"):
        condition &= F.col("detector_id") == value("detector:")
    if value("rule:"):
        condition &= F.col("rule_id") == value("rule:")
    if value("language:"):
        condition &= text.facet_extension(F.col("path")) == value("language:")
    return condition


def facet_query(store: DataFrame, query: str) -> DataFrame:
    return store.filter(facet_condition(query))


def query_sources(repos: DataFrame, q: str | None = None, kind: str | None = None) -> DataFrame:
    """Repositories whose name or description contains the text, of one type, by name."""
    out = repos
    if q and q.strip():
        wanted = q.strip().lower()
        out = out.filter(
            F.lower("name").contains(wanted)
            | F.coalesce(F.lower("description").contains(wanted), F.lit(False))
        )
    if kind and kind.strip():
        out = out.filter(F.col("type") == kind.strip())
    return out.orderBy(F.lower("name"))


def discover_repos(listing: DataFrame, name_filter: str | None = None, include_archived: bool = False) -> DataFrame:
    out = listing if include_archived else listing.filter(~F.col("archived"))
    return out.filter(F.col("name").rlike(name_filter)) if name_filter and name_filter.strip() else out


def counts_by_severity(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys, "severity").agg(F.count("*").alias("n"))


def dashboard_severity_counts(store: DataFrame) -> DataFrame:
    """Open findings per severity, zeros included: one row per severity from one
    aggregation over five counters."""
    opened = F.col("triage_status") == "OPEN"
    counted = store.agg(
        *[F.count_if(opened & (F.col("severity") == s)).alias(s) for s in fv.SEVERITIES]
    )
    pairs = ", ".join(f"'{s}', {s}" for s in fv.SEVERITIES)
    return counted.selectExpr(f"stack({len(fv.SEVERITIES)}, {pairs}) as (severity, n)")


def open_closed_counts(store: DataFrame) -> DataFrame:
    opened = F.col("triage_status") == "OPEN"
    return store.agg(F.count_if(opened).alias("open"), F.count_if(~opened).alias("closed"))


def dominant_language(store: DataFrame) -> DataFrame:
    """Most frequent extension among a repository's findings; '' if there is none."""
    ext = text.file_extension(F.col("path"))
    per_ext = store.groupBy("repo_id", ext.alias("ext")).agg(F.count("*").alias("n"))
    named = F.col("ext") != ""
    # Ties go to the first name in alphabetical order.
    best = F.min_by("ext", F.when(named, F.struct(-F.col("n"), F.col("ext"))))
    return per_ext.groupBy("repo_id").agg(
        F.coalesce(F.when(F.max(named), best), F.lit("")).alias("language")
    )


def scan_time() -> Column:
    return F.coalesce("finished_at", "started_at")


def recent_scans(records: DataFrame, limit: int) -> DataFrame:
    return records.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)


def last_scans(records: DataFrame, among_newest: int | None = None) -> DataFrame:
    """Latest scan per repository; on request among the newest runs overall only."""
    pool = records if among_newest is None else recent_scans(records, among_newest)
    return pool.groupBy("repo_id").agg(
        F.max_by(
            F.struct(scan_time().alias("last_scan_at"), F.col("status"), F.col("error_message")),
            F.struct(scan_time(), F.col("id")),
        ).alias("last")
    ).select(
        "repo_id",
        "last.last_scan_at",
        F.col("last.status").alias("last_status"),
        F.col("last.error_message").alias("last_error"),
    )


def repository_cards(
    repos: DataFrame, records: DataFrame, store: DataFrame, language: str | None = None, sort: str = "updated"
) -> DataFrame:
    """Repositories with language and last scan, on request those of one language; last updated
    first and never scanned last, or by name."""
    base = repos.withColumn("repo_id", F.col("name"))
    joined = lookup_join(base, dominant_language(store), ["repo_id"], "left")
    joined = lookup_join(joined, last_scans(records), ["repo_id"], "left")
    cards = joined.withColumn("language", F.coalesce("language", F.lit(""))).drop("repo_id")
    if language is not None:
        cards = cards.filter(F.col("language") == language)
    order = {"updated": [F.col("last_scan_at").desc_nulls_last(), "name"], "name": [F.lower("name"), "name"]}[sort]
    return cards.orderBy(*order)


def report_rows(store: DataFrame, rows: int = fv.REPORT_ROWS) -> DataFrame:
    """The first rows of each scan's report, worst first. Spark cuts the groups to
    that size before the shuffle."""
    w = Window.partitionBy("scan_id").orderBy(F.col("severity_rank").desc(), "path", "line_no", "id")
    return store.withColumn("row_no", F.row_number().over(w)).filter(F.col("row_no") <= rows)


def scan_report_summary(store: DataFrame, rows: int = fv.REPORT_ROWS) -> DataFrame:
    """Per scan: total, count per severity, how many rows lie beyond the report."""
    counts = [
        F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(fv.SEVERITIES)
    ]
    return store.groupBy("scan_id").agg(F.count("*").alias("total"), *counts).withColumn(
        "more", F.greatest(F.col("total") - rows, F.lit(0))
    )


def notify_candidates(findings: DataFrame, threshold: str = "HIGH") -> DataFrame:
    """Repositories whose worst finding reaches the threshold."""
    rank = text.severity_rank(F.col("severity"))
    worst = findings.groupBy("repo_id").agg(F.max(rank).alias("rank"), F.count("*").alias("finding_count"))
    return worst.filter(F.col("rank") >= fv.SEVERITIES.index(threshold)).select(
        "repo_id", text.severity_name(F.col("rank")).alias("highest_severity"), "finding_count"
    )


def facet_values(store: DataFrame) -> DataFrame:
    """The detectors, rules and extensions that occur, as rows."""
    occurring = store.select("detector_id", "rule_id", text.facet_extension(F.col("path")).alias("ext")).distinct()
    return (
        occurring.selectExpr(
            "stack(3, 'detector', detector_id, 'rule', rule_id, 'language', ext) as (facet, value)"
        )
        .filter(F.col("value") != "")
        .distinct()
        .orderBy("facet", "value")
    )


def report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.col("severity_rank").desc(), "repo_id", "fingerprint")


def sorted_findings(store: DataFrame, key: str = "severity") -> DataFrame:
    """By severity (worst first), last_seen or first_seen (newest first)."""
    order = {"severity": "severity_rank", "last_seen": "last_seen", "first_seen": "first_seen"}[key]
    return store.orderBy(F.col(order).desc(), "id")


def recent_audit(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.col("at").desc(), "target").limit(limit)


def stale_runs(records: DataFrame, now: Column, max_age_s: int = 120) -> DataFrame:
    """Running scans without a heartbeat, or with one older than the limit."""
    limit = now - F.make_dt_interval(secs=F.lit(max_age_s))
    return records.filter(
        (F.col("status") == "RUNNING") & (F.col("claimed_at").isNull() | (F.col("claimed_at") < limit))
    )


def requeue_stale(records: DataFrame, now: Column, max_age_s: int = 120) -> DataFrame:
    """All records, the stale ones back in the queue."""
    limit = now - F.make_dt_interval(secs=F.lit(max_age_s))
    stale = (F.col("status") == "RUNNING") & (
        F.col("claimed_at").isNull() | (F.col("claimed_at") < limit)
    )
    return records.withColumns(
        {
            "status": F.when(stale, F.lit("QUEUED")).otherwise(F.col("status")),
            "progress": F.when(stale, F.lit(0)).otherwise(F.col("progress")),
            "claimed_at": F.when(~stale, F.col("claimed_at")),
        }
    )


# How web hosts address a line of a file: folder between repository and revision, and the mark
# before the line number. Fixed by the hosts.
HOST_STYLES = {"bitbucket.org": ("src", "#lines-")}
USUAL_STYLE = ("blob", "#L")


def _web_address(location: Column) -> tuple[Column, Column]:
    """Host and repository folder of a clone address, null unless it names a web host. The short
    form user@host:folder is read as ssh://user@host/folder, so one parser serves all forms."""
    short = F.regexp_replace(location, r"^([^/@:]+@[^/:]+):(?!/)", "ssh://$1/")
    url = F.when(short.rlike(r"^(https?|ssh)://[^/]+/."), short)
    host = F.try_parse_url(url, F.lit("HOST"))
    folder = F.trim(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), r"^/+|/*\.git$|/+$", ""))
    return host, F.when(folder != "", folder)


def source_links(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings with a web link to their line; null where the repository is unknown or has no web
    host."""
    host, folder = _web_address(F.trim("location"))
    known = repos.select(
        F.col("name").alias("repo_id"),
        F.concat_ws("/", F.lit("https:/"), host, folder).alias("_base"), host.alias("_host"), folder.alias("_folder"),
        F.coalesce(text.blank_to_null(F.get("branches", F.lit(0))), F.lit("HEAD")).alias("_ref"),
    )

    def styled(part: int) -> Column:
        out = F.lit(USUAL_STYLE[part])
        for name, style in HOST_STYLES.items():
            out = F.when(F.col("_host") == name, F.lit(style[part])).otherwise(out)
        return out

    line = F.when(F.col("line_no") > 0, F.concat(styled(1), F.col("line_no"))).otherwise(F.lit(""))
    file = F.ltrim(F.col("path"), F.lit("/"))
    link = F.concat(F.concat_ws("/", "_base", styled(0), "_ref", file), line)
    linked = F.col("_host").isNotNull() & F.col("_folder").isNotNull() & (F.col("path") != "")
    return (
        lookup_join(findings, known, ["repo_id"], "left")
        .withColumn("link", F.when(linked, link)).drop("_base", "_host", "_folder", "_ref")
    )
