"""Queries over unit tables, value sources, ingest and repository listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common, sql
from catalog.registry import plain, query
from veilscan.functions import fixed_values as fv, text
from veilscan.operators import query as qo, rulesets, values as vo
from veilscan.operators.detect import detect
from veilscan.session import materialise, work_dir
from veilscan.sources import corpora, store as st, units as un, values as vs

q = sql.with_query
PEPPER = "salt&pepper"


@query("scan_units", f"SELECT repo_id, path, commit_id, author, ts, length(content) AS n_chars, sha256(content) AS digest FROM ({sql.ALL_UNITS})")
def scan_units(spark, sf_dir):
    units = corpora.all_units(spark, sf_dir)
    return plain(
        units, "repo_id", "path", "commit_id", "author", "ts",
        F.length("content").cast("bigint").alias("n_chars"), F.sha2("content", 256).alias("digest"),
    )


_VARIANTS = (
    "SELECT source AS repo_id, 'f' || doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN text || chr(0) "
    "WHEN doc_id % 9 = 1 THEN repeat('x', 8000) || chr(0) || text "
    "WHEN doc_id % 97 = 5 THEN repeat(text || ' ', (2000000 // (strlen(text) + 1) + 1)::INTEGER) ELSE text END AS content FROM documents"
)


@query("blob_guard", q(
    f"units AS ({_VARIANTS})",
    f"SELECT repo_id, path, strlen(content) AS bytes FROM units WHERE {sql.BLOB_OK}",
))
def blob_guard(spark, sf_dir):
    """Documents, some made too large and some given a NUL early or late."""
    units = _variants(spark, sf_dir)
    return un.blob_guard(units, fv.MAX_BLOB_BYTES, fv.NUL_PROBE_BYTES).select(
        "repo_id", "path", F.octet_length("content").cast("bigint").alias("bytes")
    )


@query("skipped_units", q(
    f"units AS ({_VARIANTS})",
    f"SELECT repo_id, path, strlen(content) AS bytes, CASE WHEN strlen(content) > {fv.MAX_BLOB_BYTES} THEN 'size' ELSE 'binary' END AS reason "
    f"FROM units WHERE NOT ({sql.BLOB_OK})",
))
def skipped_units(spark, sf_dir):
    """What the same limits leave out."""
    units = _variants(spark, sf_dir).withColumn("commit_id", F.lit("c"))
    return un.skipped_units(units, fv.MAX_BLOB_BYTES, fv.NUL_PROBE_BYTES).drop("commit_id")


def _variants(spark, sf_dir):
    docs = corpora.read_table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    times = (F.floor(F.lit(2000000) / (F.octet_length("text") + 1)) + 1).cast("int")
    content = (
        F.when(n % 9 == 0, F.concat("text", F.lit("\x00")))
        .when(n % 9 == 1, F.concat(F.repeat(F.lit("x"), F.lit(8000)), F.lit("\x00"), F.col("text")))
        .when(n % 97 == 5, F.repeat(F.concat("text", F.lit(" ")), times))
        .otherwise(F.col("text"))
    )
    return docs.select(
        F.col("source").alias("repo_id"), F.concat(F.lit("f"), n).alias("path"), content.alias("content")
    )


_BRANCHED = (
    f"branched AS (SELECT h.*, b.branch FROM ({common.HISTORY}) h, (VALUES ('main', 0), ('dev', 1)) b(branch, k) "
    "WHERE k = 0 OR ts % 120 = 0)"
)


def _branched(spark, sf_dir):
    """History with the even minutes on two branches."""
    two = F.array(F.lit("main"), F.lit("dev"))
    branches = F.when(F.unix_timestamp("ts") % 120 == 0, two).otherwise(F.array(F.lit("main")))
    return common.history(spark, sf_dir).withColumn("branch", F.explode(branches))


@query("select_history_full", q(
    _BRANCHED, "SELECT DISTINCT repo_id, path, commit_id, ts, sha256(content) AS digest FROM branched",
))
def select_history_full(spark, sf_dir):
    """By the digests of the contents: what is kept after the choice needs no more of them."""
    units = _branched(spark, sf_dir).withColumn("digest", F.sha2("content", 256)).drop("content")
    chosen = un.select_history(units, "FULL")
    return plain(chosen, "repo_id", "path", "commit_id", "ts", "digest")


@query("select_history_head", q(
    f"h AS ({common.HISTORY}), heads AS (SELECT repo_id, arg_max(commit_id, {{'a': ts, 'b': commit_id}}) AS commit_id FROM h GROUP BY repo_id)",
    "SELECT repo_id, path, commit_id, ts FROM h JOIN heads USING (repo_id, commit_id)",
))
def select_history_head(spark, sf_dir):
    chosen = un.select_history(common.history(spark, sf_dir), "HEAD")
    return plain(chosen, "repo_id", "path", "commit_id", "ts")


_SEEN = f"seen AS (SELECT DISTINCT repo_id, commit_id FROM ({common.HISTORY}) WHERE ts < {corpora.EPOCH_2024 + 43200})"


def _seen(spark, sf_dir):
    early = F.col("ts") < F.timestamp_seconds(F.lit(corpora.EPOCH_2024 + 43200))
    return un.mark_seen(common.history(spark, sf_dir).filter(early))


@query("select_history_incremental", q(
    f"h AS ({common.HISTORY}), {_SEEN}",
    "SELECT repo_id, path, commit_id, ts FROM h WHERE (repo_id, commit_id) NOT IN (SELECT (repo_id, commit_id) FROM seen)",
))
def select_history_incremental(spark, sf_dir):
    seen = materialise(_seen(spark, sf_dir), "seen")
    chosen = un.select_history(common.history(spark, sf_dir), "INCREMENTAL", seen=seen)
    return plain(chosen, "repo_id", "path", "commit_id", "ts")


@query("mark_seen", q(f"h AS ({common.HISTORY})", "SELECT DISTINCT repo_id, commit_id FROM h"))
def mark_seen(spark, sf_dir):
    return un.mark_seen(common.history(spark, sf_dir), _seen(spark, sf_dir))


@query("classify_file_type", q(
    f"units AS ({sql.ALL_UNITS} UNION ALL {sql.INFRASTRUCTURE})",
    f"SELECT repo_id, path, {sql.FILE_TYPE} AS file_type FROM units",
))
def classify_file_type(spark, sf_dir):
    units = corpora.all_units(spark, sf_dir).unionByName(corpora.infrastructure_units(spark, sf_dir))
    return units.select("repo_id", "path", text.file_type(F.col("path")).alias("file_type"))


@query("route_by_file_type", q(
    f"units AS ({sql.ALL_UNITS} UNION ALL {sql.INFRASTRUCTURE}), typed AS (SELECT repo_id, {sql.FILE_TYPE} AS ft FROM units)",
    "SELECT repo_id, count(*) AS secrets, count(*) FILTER (ft <> 'BINARY') AS pii, count(*) FILTER (ft IN ('CONFIG','OTHER')) AS iac FROM typed GROUP BY repo_id",
))
def route_by_file_type(spark, sf_dir):
    """How many units each detector group reads."""
    units = corpora.all_units(spark, sf_dir).unionByName(corpora.infrastructure_units(spark, sf_dir))
    return un.with_file_type(units).groupBy("repo_id").agg(
        F.count("*").alias("secrets"),
        F.count_if(F.col("file_type") != "BINARY").alias("pii"),
        F.count_if(F.col("file_type").isin("CONFIG", "OTHER")).alias("iac"),
    )


@query("explode_lines", q(
    sql.lines_ctes(sql.ALL_UNITS),
    "SELECT repo_id, path, line_no, length(line) AS n, sha256(line) AS digest, sha256(coalesce(prev_line, '')) AS prev_digest FROM lines",
))
def explode_lines(spark, sf_dir):
    lines = un.explode_lines(corpora.all_units(spark, sf_dir))
    return lines.select(
        "repo_id", "path", "line_no", F.length("line").cast("bigint").alias("n"),
        F.sha2("line", 256).alias("digest"), F.sha2(F.coalesce("prev_line", F.lit("")), 256).alias("prev_digest"),
    )


@query("skipped_lines", q(
    sql.lines_ctes(sql.ALL_UNITS, None),
    "SELECT repo_id, count(*) AS total_lines, count(*) FILTER (length(line) > 4000) AS skipped_lines FROM lines GROUP BY repo_id",
))
def skipped_lines(spark, sf_dir):
    return un.skipped_lines(corpora.all_units(spark, sf_dir))


_CATALOG_SQL = (
    "rules(rule_id, detector_id, category, default_severity, default_enabled) AS (VALUES "
    + ", ".join(
        [f"('{r.rule_id}', 'secret.regex-ruleset', 'SECRET', '{r.severity}', true)" for r in fv.SECRET_RULES]
        + [f"('{r.rule_id}', 'iac.misconfig', 'IAC', '{r.severity}', true)" for r in fv.IAC_RULES]
        + [f"('{r.rule_id}', 'pii.patterns', 'PII', '{r.severity}', {str(r.rule_id != 'phone').lower()})" for r in fv.PII_RULES]
        + [
            "('high-entropy-string', 'secret.high-entropy', 'SECRET', 'MEDIUM', true)",
            "('pii.custom-regex', 'pii.custom-regex', 'PII', 'MEDIUM', true)",
            "('pii.customer-data-api', 'pii.customer-data-api', 'PII', 'MEDIUM', true)",
        ]
    )
    + ")"
)


@query("rule_catalog_usage", q(
    f"{sql.findings_ctes(sql.PLANTED, common.CONFIG)}, {_CATALOG_SQL}",
    "SELECT rule_id, c.detector_id, c.category, default_severity, default_enabled, count(r.path) AS findings "
    "FROM rules c LEFT JOIN raw r USING (rule_id) GROUP BY ALL",
))
def rule_catalog_usage(spark, sf_dir):
    """Every rule of every detector with the number of findings it has."""
    used = detect(corpora.planted_units(spark, sf_dir), common.CONFIG).groupBy("rule_id").agg(
        F.count("*").alias("findings")
    )
    return rulesets.rule_catalog(spark).join(used, "rule_id", "left").select(
        "rule_id", "detector_id", "category", "default_severity", "default_enabled",
        F.coalesce("findings", F.lit(0)).alias("findings"),
    )


@query("rules_table_usage", q(
    f"{sql.findings_ctes(sql.INFRASTRUCTURE, common.CONFIG.__class__(groups=('secrets', 'iac')))}, rules(rule_id, target, n_chars) AS (VALUES "
    + ", ".join(f"('{r.rule_id}', {sql.lit(r.target) if r.target else 'NULL'}, {len(r.pattern)})" for r in (*fv.SECRET_RULES, *fv.IAC_RULES))
    + ")",
    "SELECT rule_id, target, n_chars::INTEGER AS n_chars, count(path) AS findings FROM rules LEFT JOIN raw USING (rule_id) GROUP BY ALL",
))
def rules_table_usage(spark, sf_dir):
    config = common.CONFIG.__class__(groups=("secrets", "iac"))
    used = detect(corpora.infrastructure_units(spark, sf_dir), config).groupBy("rule_id").agg(
        F.count("*").alias("findings")
    )
    return rulesets.rules_table(spark).join(used, "rule_id", "left").select(
        "rule_id", "target", F.length("regex").alias("n_chars"), F.coalesce("findings", F.lit(0)).alias("findings")
    )


# --- value sources ------------------------------------------------------------------

@query("key_values_csv", (
    "SELECT key, value FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'nation' || c_nationkey END AS key, c_name AS value FROM customer) "
    "WHERE key IS NOT NULL"
))
def key_values_csv(spark, sf_dir):
    """Customers as upload lines: quoted, plain, header and broken ones."""
    n = F.col("c_custkey") % 3
    line = (
        F.when(n == 0, F.concat(F.lit(' "'), "c_mktsegment", F.lit('" ; "'), "c_name", F.lit('"')))
        .when(n == 1, F.concat(F.lit("nation"), "c_nationkey", F.lit(", "), "c_name", F.lit("\r")))
        .when(F.col("c_custkey") % 2 == 0, F.lit("Key;VALUE"))
        .otherwise(F.col("c_name"))
    )
    rows = corpora.read_table(spark, sf_dir, "customer").select(line.alias("line"))
    return vs.key_values_of_lines(rows, F.col("line"))


@query("key_values_json", (
    "SELECT key, value FROM (SELECT 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE event_id % 3 = 0 "
    "UNION ALL SELECT event_type, event_id::VARCHAR FROM events WHERE event_id % 3 = 1 "
    "UNION ALL SELECT unnest(['type', 'user']), unnest([event_type, user_id::VARCHAR]) FROM events WHERE event_id % 3 = 2)"
))
def key_values_json(spark, sf_dir):
    """Events as JSON uploads in the three accepted shapes."""
    n = F.col("event_id") % 3
    document = (
        F.when(n == 0, F.col("props"))
        .when(n == 1, F.concat(F.lit('[{"key": "'), "event_type", F.lit('", "value": '), "event_id", F.lit("}]")))
        .otherwise(F.concat(F.lit(' [{"type": "'), "event_type", F.lit('", "user": "'), "user_id", F.lit('", "none": null, "blank": " ", "nest": {"a": "b"}, "list": ["c"]}]')))
    )
    rows = corpora.read_table(spark, sf_dir, "events").select(document.alias("d"))
    return vs.key_values_of_json(rows, F.col("d"))


@query("key_values_uploads", (
    "SELECT 'csv' AS upload, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'nation' || c_nationkey END AS key, c_name AS value FROM customer "
    "UNION ALL SELECT 'lines', event_type, event_id::VARCHAR FROM events "
    "UNION ALL SELECT 'document', 'n' || n_nationkey, n_name FROM nation"
))
def key_values_uploads(spark, sf_dir):
    """Uploads on disk: CSV with a header, JSON lines, and one JSON document over many lines."""
    customers = corpora.read_table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("nation"), "c_nationkey"))
    csv, lines, document = (work_dir(spark, f"upload-{n}") for n in ("csv", "lines", "document"))
    customers.select(key.alias("key"), F.col("c_name").alias("value")).write.option("header", "true").csv(csv)
    events = corpora.read_table(spark, sf_dir, "events")
    pair = F.struct(F.col("event_type").alias("key"), F.col("event_id").alias("value"))
    events.select(F.to_json(pair).alias("value")).write.text(lines)
    nations = corpora.read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit('{"key": "n'), "n_nationkey", F.lit('",\n "value": "'), "n_name", F.lit('"}')).alias("item")
    )
    whole = nations.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("item"), ",\n"), F.lit("\n]")).alias("value"))
    whole.write.text(document)
    found = None
    for name, path in (("csv", csv), ("lines", lines), ("document", document)):
        one = vs.read_key_values(spark, path).select(F.lit(name).alias("upload"), "key", "value")
        found = one if found is None else found.unionByName(one)
    return found


@query("checked_values", (
    "SELECT DISTINCT source_id, attribute, value, CASE attribute WHEN 'BUILDING' THEN 'LOW' ELSE 'MEDIUM' END AS severity, "
    "CASE attribute WHEN 'BUILDING' THEN 'CUSTOM' ELSE 'PII' END AS category FROM (SELECT (['crm','erp','old'])[c_custkey % 3 + 1] AS source_id, "
    "c_mktsegment AS attribute, c_name AS value FROM customer) WHERE source_id <> 'old' AND NOT (source_id = 'crm' AND attribute = 'MACHINERY')"
))
def checked_values(spark, sf_dir):
    """Customers as values of three sources, one of them off, with a rule for some attributes."""
    source = F.element_at(F.array(F.lit("crm"), F.lit("erp"), F.lit("old")), (F.col("c_custkey") % 3 + 1).cast("int"))
    values = corpora.read_table(spark, sf_dir, "customer").select(
        source.alias("source_id"), F.col("c_mktsegment").alias("attribute"), F.col("c_name").alias("value")
    ).distinct()
    rules = spark.createDataFrame(
        [("crm", "BUILDING", True, "LOW", "CUSTOM"), ("erp", "BUILDING", True, "LOW", "CUSTOM"), ("crm", "MACHINERY", False, "HIGH", "PII")],
        "source_id string, field string, checked boolean, severity string, category string",
    )
    sources = spark.createDataFrame([("crm", True), ("erp", True), ("old", False)], "id string, enabled boolean")
    return vs.checked_values(values, rules, sources).select("source_id", "attribute", "value", "severity", "category")


@query("records_at_path", (
    "SELECT event_id, unnest(['{\"t\":\"' || event_type || '\"}', props]) AS record FROM events WHERE event_id % 4 = 0 "
    "UNION ALL SELECT event_id, props FROM events WHERE event_id % 4 = 1"
))
def records_at_path(spark, sf_dir):
    """Records below data.items: an array, one object, nothing, or null."""
    n = F.col("event_id") % 4
    body = (
        F.when(n == 0, F.concat(F.lit('{"items": [{"t":"'), "event_type", F.lit('"}, '), "props", F.lit("]}")))
        .when(n == 1, F.concat(F.lit('{"items": '), "props", F.lit("}")))
        .when(n == 2, F.lit('{"other": 1}'))
        .otherwise(F.lit('{"items": null}'))
    )
    rows = corpora.read_table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit('{"data": '), body, F.lit("}")).alias("d")
    )
    found = vs.records_at_path(rows, F.col("d"), "$.data.items[*]")
    compact = F.regexp_replace("record", r"\s+", "")
    original = F.when(compact.startswith('{"k":'), F.concat(F.lit('{"k": '), F.substr(compact, F.lit(6)))).otherwise(compact)
    return found.select("event_id", original.alias("record"))


@query("load_value_columns", (
    "SELECT DISTINCT attribute, value FROM (SELECT unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS attribute, "
    "unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer) WHERE length(value) >= 4"
))
def load_value_columns(spark, sf_dir):
    return vs.load_value_columns(
        corpora.read_table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"]
    )


@query("load_record_values", (
    "SELECT DISTINCT 'type' AS attribute, event_type AS value FROM events WHERE length(event_type) >= 4 UNION "
    "SELECT 'id', event_id::VARCHAR FROM events WHERE event_id >= 1000 AND event_id % 2 = 0"
))
def load_record_values(spark, sf_dir):
    """Events as records: text, a number or an object, null, a nested array."""
    e = F.col("event_id")
    ident = F.when(e % 2 == 0, e.cast("string")).otherwise(F.concat(F.lit('{"n": '), e, F.lit("}")))
    record = F.concat(
        F.lit('{"type": "'), "event_type", F.lit('", "id": '), ident, F.lit(', "list": ["aaaa"], "none": null, "props": '), "props", F.lit("}")
    )
    rows = corpora.read_table(spark, sf_dir, "events").select(record.alias("record"))
    return vs.load_record_values(rows, ["type", "id", "list", "none", "props", "absent"])


_MASK = "CASE WHEN v IS NULL THEN '' WHEN length(v) <= 2 THEN repeat('*', length(v)) ELSE left(v, 2) || repeat('*', length(v) - 2) END"


@query("profile_source", (
    f"SELECT true AS reachable, (SELECT count(*) FROM customer) AS records, attribute, {_MASK} AS sample FROM (SELECT unnest(['c_custkey', 'c_name', 'c_mktsegment']) AS attribute, "
    "unnest([c_custkey::VARCHAR, c_name, c_mktsegment]) AS v FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1))"
))
def profile_source(spark, sf_dir):
    records = corpora.read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return vs.profile_source(records, "c_custkey")


_CUSTOMER_PAIRS = "pairs AS (SELECT c_mktsegment AS key, c_name AS value FROM customer UNION ALL SELECT 'city', left(c_name, 3) FROM customer)"


def _customer_pairs(spark, sf_dir):
    customers = corpora.read_table(spark, sf_dir, "customer")
    return customers.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("value")).unionByName(
        customers.select(F.lit("city").alias("key"), F.substring("c_name", 1, 3).alias("value"))
    )


@query("hash_values", q(
    _CUSTOMER_PAIRS,
    f"SELECT DISTINCT key AS attribute, sha256('{PEPPER}' || value) AS value_hash FROM pairs WHERE length(value) >= 4",
))
def hash_values(spark, sf_dir):
    return vs.hash_values(_customer_pairs(spark, sf_dir), PEPPER)


@query("count_values", q(
    _CUSTOMER_PAIRS,
    "SELECT key AS attribute, count(DISTINCT value) AS values FROM pairs WHERE length(value) >= 4 GROUP BY key",
))
def count_values(spark, sf_dir):
    return vs.count_values(vs.hash_values(_customer_pairs(spark, sf_dir), PEPPER))


@query("default_attribute_rules", q(
    _CUSTOMER_PAIRS,
    "SELECT 'crm' AS source_id, 'BUILDING' AS field, false AS checked, 'LOW' AS severity, 'CUSTOM' AS category UNION ALL "
    "SELECT DISTINCT 'crm', key, true, 'MEDIUM', 'PII' FROM pairs WHERE length(value) >= 4 AND key <> 'BUILDING'",
))
def default_attribute_rules(spark, sf_dir):
    rules = spark.createDataFrame(
        [("crm", "BUILDING", False, "LOW", "CUSTOM"), ("erp", "MACHINERY", True, "HIGH", "PII")],
        "source_id string, field string, checked boolean, severity string, category string",
    )
    return vs.default_attribute_rules(vs.hash_values(_customer_pairs(spark, sf_dir), PEPPER), rules, "crm")


# --- value detection ----------------------------------------------------------------

_WORDS = (
    "words AS (SELECT DISTINCT value FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+')) AS value FROM benchmark) WHERE length(value) >= 8)"
)
_ALL_LINES = sql.lines_ctes(sql.ALL_UNITS, None)


@query("detect_values", q(
    f"{_ALL_LINES}, {_WORDS}, found AS (SELECT DISTINCT repo_id, path, commit_id, ts, line_no, token FROM (SELECT *, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{Nd}}_]+')) AS token FROM lines WHERE file_type <> 'BINARY') WHERE token IN (SELECT value FROM words))",
    f"SELECT repo_id, 'pii.customer-data-api' AS detector_id, 'PII' AS category, 'HIGH' AS severity, 'passage_word' AS rule_id, path, line_no, {sql.REDACT.replace('m,', 'token,').replace('(m)', '(token)')} AS redacted_match, commit_id, ts, false AS verified FROM found",
))
def detect_values(spark, sf_dir):
    found = vo.detect_values(corpora.all_units(spark, sf_dir), corpora.passage_words(spark, sf_dir))
    return plain(found)


_PHRASES = (
    "phrases AS (SELECT DISTINCT text AS value FROM benchmark WHERE text <> '' UNION SELECT '. ' UNION SELECT '???')"
)


@query("detect_phrases", q(
    f"{_ALL_LINES}, {_PHRASES}",
    "SELECT repo_id, path, line_no, length(value)::INTEGER AS n, sha256(value) AS digest FROM "
    "(SELECT *, string_split(line, value) AS ps FROM lines, phrases WHERE file_type <> 'BINARY' AND contains(line, value)) "
    "WHERE len(list_filter(range(1, len(ps)), lambda i: "
    "NOT regexp_matches(CASE WHEN ps[i] <> '' THEN right(ps[i], 1) WHEN i = 1 THEN '' ELSE right(value, 1) END, '[\\p{L}\\p{Nd}_]') "
    "AND NOT regexp_matches(CASE WHEN ps[i + 1] <> '' THEN left(ps[i + 1], 1) WHEN i + 1 = len(ps) THEN '' ELSE left(value, 1) END, '[\\p{L}\\p{Nd}_]'))) > 0",
))
def detect_phrases(spark, sf_dir):
    """Values of several words, and values without any word."""
    passages = corpora.read_table(spark, sf_dir, "benchmark").filter("text <> ''")
    values = passages.select(F.col("text").alias("value")).distinct()
    more = spark.createDataFrame([(". ",), ("???",)], "value string")
    known = values.unionByName(more).select(F.sha2("value", 256).alias("attribute"), "value")
    found = vo.detect_values(corpora.all_units(spark, sf_dir), known)
    return found.select(
        "repo_id", "path", "line_no", F.length("redacted_match").alias("n"), F.col("rule_id").alias("digest")
    )


@query("detect_hashed_values", q(
    f"{_ALL_LINES}, {_WORDS}, hashes AS (SELECT sha256('{PEPPER}' || value) AS h FROM words), "
    f"tokens AS (SELECT *, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{Nd}}_]+')) AS m FROM lines WHERE file_type <> 'BINARY')",
    f"SELECT repo_id, path, line_no, 'passage_word' AS rule_id, {sql.REDACT} AS redacted_match FROM tokens WHERE length(m) >= 4 AND sha256('{PEPPER}' || m) IN (SELECT h FROM hashes)",
))
def detect_hashed_values(spark, sf_dir):
    pairs = corpora.passage_words(spark, sf_dir).withColumnRenamed("attribute", "key")
    hashes = vs.hash_values(pairs, PEPPER)
    found = vo.detect_hashed_values(corpora.all_units(spark, sf_dir), hashes, PEPPER)
    return found.select("repo_id", "path", "line_no", "rule_id", "redacted_match")


# --- ingest and listings ------------------------------------------------------------

_FEED = (
    "latest AS (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id)"
)


def _feed(spark, sf_dir):
    return feed_of(corpora.read_table(spark, sf_dir, "events"))


def feed_of(events):
    """Events as CI deliveries: one run per user, delivered again and again."""
    finding = (
        '{"detectorId":"secret.regex-ruleset","ruleId":"rule-', '","file":"src/f', '.java","line":',
        ',"redactedMatch":"****"}',
    )
    e = F.col("event_id")
    body = F.concat(
        F.lit('{"repoId":"repo'), F.col("user_id") % 20, F.lit('","ci":{"runRef":"run-'), F.col("user_id"),
        F.lit('","branch":" "},"findings":['),
        F.lit(finding[0]), F.col("event_type"), F.lit(finding[1]), e, F.lit(finding[2]), e % 50 + 1, F.lit(finding[3]),
        F.lit(',{"ruleId":"x","severity":"LOW","category":"PII","file":"a","line":1,"redactedMatch":"**","fingerprint":"fp'),
        e, F.lit('","verified":true},{"ruleId":" ","redactedMatch":"*"}]}'),
    )
    return events.select(e.alias("seq"), body.alias("body"))


@query("ingest_records", q(
    _FEED,
    "SELECT sha256('run/run-' || user_id) AS scan_id, 'repo' || (user_id % 20) AS repo_id, 'diff' AS mode, 'COMPLETED' AS status, 3::INTEGER AS finding_count, 'run-' || user_id AS run_ref, NULL::VARCHAR AS branch FROM latest",
))
def ingest_records(spark, sf_dir):
    runs = st.parse_ingest(_feed(spark, sf_dir), F.col("body"))
    return st.ingested_records(runs).select(
        "scan_id", "repo_id", "mode", "status", "finding_count", "ci.run_ref", "ci.branch"
    )


@query("ingest_findings", q(
    _FEED,
    "SELECT sha256('run/run-' || user_id) AS scan_id, 'repo' || (user_id % 20) AS repo_id, 'SECRET' AS category, 'MEDIUM' AS severity, 'rule-' || event_type AS rule_id, "
    "'repo' || (user_id % 20) || ':rule-' || event_type || ':src/f' || event_id || '.java:' || (event_id % 50 + 1) AS fingerprint, false AS verified FROM latest "
    "UNION ALL SELECT sha256('run/run-' || user_id), 'repo' || (user_id % 20), 'PII', 'LOW', 'x', 'fp' || event_id, true FROM latest",
))
def ingest_findings(spark, sf_dir):
    runs = st.parse_ingest(_feed(spark, sf_dir), F.col("body"))
    return st.ingested_findings(runs).select(
        "scan_id", "repo_id", "category", "severity", "rule_id", "fingerprint", "verified"
    )


@query("discover_repos", q(
    common.REPOSITORIES, "SELECT name, type, location FROM repos WHERE NOT archived AND regexp_matches(name, 'src1?[0-9]$')",
))
def discover_repos(spark, sf_dir):
    listing = corpora.repositories(spark, sf_dir)
    return qo.discover_repos(listing, "src1?[0-9]$").select("name", "type", "location")


@query("configured_and_discovered", q(
    common.REPOSITORIES, "SELECT name, 'configured' AS origin FROM repos WHERE enabled UNION ALL SELECT name, 'discovered' FROM repos",
))
def configured_and_discovered(spark, sf_dir):
    listing = corpora.repositories(spark, sf_dir)
    configured = listing.filter("enabled").select("name", F.lit("configured").alias("origin"))
    found = qo.discover_repos(listing, None, include_archived=True)
    return configured.unionByName(found.select("name", F.lit("discovered").alias("origin")))


@query("query_sources", q(
    common.REPOSITORIES, "SELECT name, type, description FROM repos WHERE (contains(lower(name), 'c1') OR contains(lower(description), 'us src1')) AND type = 'gitlab'",
))
def query_sources(spark, sf_dir):
    return qo.query_sources(corpora.repositories(spark, sf_dir), " C1", "gitlab").select("name", "type", "description")


# --- lists, tokens, masks -----------------------------------------------------------

_LISTS = "lists(kind, entry) AS (VALUES " + ", ".join(
    f"('{kind}', {sql.lit(e)})"
    for kind, entries in (
        ("address", fv.TEST_MAIL_ADDRESSES), ("local_part", fv.TEST_MAIL_LOCAL_PARTS), ("domain", fv.TEST_MAIL_DOMAINS),
        ("tld", fv.TEST_MAIL_TLDS), ("sld", fv.TEST_MAIL_SLDS),
    )
    for e in entries
) + ")"


@query("mail_list_hits", q(
    f"{sql.lines_ctes(sql.ALL_UNITS + ' UNION ALL ' + sql.PLANTED)}, {_LISTS}, mails AS (SELECT repo_id, path, line_no, lower(m) AS mail, string_split(split_part(lower(m), '@', 2), '.') AS labels FROM (SELECT *, unnest(regexp_extract_all(line, {sql.lit(fv.EMAIL_PATTERN)})) AS m FROM lines))",
    "SELECT repo_id, path, line_no, kind, entry FROM mails, lists WHERE (kind = 'address' AND entry = mail) OR (kind = 'local_part' AND list_contains(string_split_regex(split_part(mail, '@', 1), '[._+-]'), entry)) "
    "OR (kind = 'domain' AND entry = split_part(mail, '@', 2)) OR (kind = 'tld' AND entry = labels[-1]) OR (kind = 'sld' AND entry = labels[-2])",
))
def mail_list_hits(spark, sf_dir):
    """Which test-mail list takes out which address."""
    from veilscan.functions.patterns import all_matches

    units = corpora.all_units(spark, sf_dir).unionByName(corpora.planted_units(spark, sf_dir))
    lines = un.explode_lines(units).filter(F.col("line").contains("@"))
    mails = lines.select(
        "repo_id", "path", "line_no", F.explode(all_matches(F.col("line"), fv.EMAIL_PATTERN)).alias("m")
    )
    parts = mails.select("repo_id", "path", "line_no", F.inline(rulesets.mail_parts(F.col("m"))))
    # About a hundred entries, fixed.
    return parts.join(F.broadcast(rulesets.test_email_lists(spark)), ["kind", "entry"]).select(
        "repo_id", "path", "line_no", "kind", "entry"
    )


@query("tokenise", q(
    _ALL_LINES,
    "SELECT repo_id, path, sum(len(regexp_extract_all(line, '[\\p{L}\\p{Nd}_]+')))::BIGINT AS tokens, sum(list_sum(list_transform(regexp_extract_all(line, '[\\p{L}\\p{Nd}_]+'), lambda t: length(t))))::BIGINT AS token_chars FROM lines GROUP BY ALL",
))
def tokenise(spark, sf_dir):
    lines = un.explode_lines(corpora.all_units(spark, sf_dir))
    found = text.tokens(F.col("line"))
    chars = F.aggregate(found, F.lit(0), lambda acc, t: acc + F.length(t))
    return lines.groupBy("repo_id", "path").agg(
        F.sum(F.size(found)).alias("tokens"), F.sum(F.when(F.size(found) > 0, chars)).alias("token_chars")
    )


@query("redact_tokens", q(
    f"t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}_]+')) AS m FROM documents)",
    f"SELECT redacted, masked, count(*) AS tokens FROM (SELECT {sql.REDACT} AS redacted, CASE WHEN length(m) <= 2 THEN repeat('*', length(m)) ELSE left(m, 2) || repeat('*', length(m) - 2) END AS masked FROM t) GROUP BY ALL",
))
def redact_tokens(spark, sf_dir):
    words = corpora.read_table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("m")).distinct()
    return words.groupBy(
        text.redact(F.col("m")).alias("redacted"), text.mask_sample(F.col("m")).alias("masked")
    ).agg(F.count("*").alias("tokens"))


@query("replace_values", q(
    f"{_WORDS}, {_CUSTOMER_PAIRS}",
    f"SELECT 'crm' AS source_id, attribute, count(*) AS values FROM (SELECT DISTINCT key AS attribute, value FROM pairs WHERE length(value) >= 4) GROUP BY ALL UNION ALL SELECT 'words', 'passage_word', count(*) FROM words",
))
def replace_values(spark, sf_dir):
    """Two sources are uploaded, then one of them again with other values."""
    from veilscan.session import work_dir

    path = work_dir(spark, "value-hashes")
    words = corpora.passage_words(spark, sf_dir).withColumnRenamed("attribute", "key")
    vs.replace_values(vs.hash_values(words, PEPPER), "words", path)
    vs.replace_values(vs.hash_values(words, PEPPER), "crm", path)
    vs.replace_values(vs.hash_values(_customer_pairs(spark, sf_dir), PEPPER), "crm", path)
    return spark.read.parquet(path).groupBy("source_id", "attribute").agg(F.count("*").alias("values"))
