"""SQL building blocks for the checks: units, lines and findings in DuckDB's dialect."""

from __future__ import annotations

from veilscan.functions import fixed_values as fv
from veilscan.operators.detect import ScanConfig
from veilscan.sources import corpora

EPOCH = corpora.EPOCH_2024


def lit(value: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(column: str, values) -> str:
    return f"{column} IN ({', '.join(lit(v) for v in values)})" if values else "false"


# --- units --------------------------------------------------------------------------

DOCUMENT_PATH = (
    "'src/' || lang || '/' || doc_id || '.' || (['java','yaml','md','png','txt'])[doc_id % 5 + 1]"
)
TEXT_PATH = "'doc/' || doc_id || '.txt'"


def document_units(path: str = DOCUMENT_PATH, content: str = "text") -> str:
    return (
        f"SELECT source AS repo_id, {path} AS path, sha256(doc_id::VARCHAR) AS commit_id, "
        f"'author' || (doc_id % 7) AS author, {EPOCH} + doc_id * 60 AS ts, {content} AS content "
        "FROM documents"
    )


DOCUMENTS = document_units()
TEXTS = document_units(TEXT_PATH)
PAGES = (
    "SELECT 'web' AS repo_id, url AS path, sha256('page' || page_id) AS commit_id, "
    f"'crawler' AS author, {EPOCH} + page_id * 60 AS ts, html AS content FROM pages"
)
CONVERSATIONS = (
    "SELECT 'chat' AS repo_id, conv_id || '/' || turn AS path, sha256('conv' || conv_id) AS commit_id, "
    f"role AS author, {EPOCH} + conv_id * 60 AS ts, text AS content FROM conversations"
)
ALL_UNITS = f"{DOCUMENTS} UNION ALL {PAGES} UNION ALL {CONVERSATIONS}"
PLANTED = document_units(
    content=f"text || chr(10) || {strings(corpora.PLANTED_LINES)}[doc_id % {len(corpora.PLANTED_LINES)} + 1]"
)
_FILES = len(corpora.PLANTED_FILES)
INFRASTRUCTURE = (
    f"SELECT source AS repo_id, 'svc' || doc_id || '/' || "
    f"{strings(p for p, _ in corpora.PLANTED_FILES)}[doc_id % {_FILES} + 1] AS path, "
    f"sha256(doc_id::VARCHAR) AS commit_id, 'ops' AS author, {EPOCH} + doc_id * 60 AS ts, "
    f"{strings(x for _, x in corpora.PLANTED_FILES)}[doc_id % {_FILES} + 1] || chr(10) || text AS content "
    "FROM documents"
)


def history(units: str) -> str:
    return (
        "SELECT repo_id, path, sha256(commit_id || '@' || day) AS commit_id, author, "
        "ts + day * 86400 AS ts, content FROM (SELECT *, unnest(range(0, "
        f"regexp_extract(path, '(\\d+)\\.\\w+$', 1)::BIGINT % 3 + 1)) AS day FROM ({units}))"
    )


# --- lines --------------------------------------------------------------------------

EXTENSION = "CASE WHEN contains(path, '.') THEN regexp_extract(lower(path), '.*\\.([^.]*)$', 1, 's') ELSE '' END"
FILE_TYPE = (
    f"CASE WHEN {in_list(f'({EXTENSION})', fv.SOURCE_EXTENSIONS)} THEN 'SOURCE' "
    f"WHEN {in_list(f'({EXTENSION})', fv.CONFIG_EXTENSIONS)} THEN 'CONFIG' "
    f"WHEN {in_list(f'({EXTENSION})', fv.DOCUMENTATION_EXTENSIONS)} THEN 'DOCUMENTATION' "
    f"WHEN {in_list(f'({EXTENSION})', fv.BINARY_EXTENSIONS)} THEN 'BINARY' ELSE 'OTHER' END"
)
IAC_TARGET = (
    "CASE WHEN lower(path) LIKE '%.tf' OR lower(path) LIKE '%.tf.json' THEN 'terraform' "
    "WHEN regexp_matches(lower(path), '(^|/)(dockerfile|dockerfile\\.[^/]*|[^/]*\\.dockerfile)$') THEN 'dockerfile' "
    "WHEN (lower(path) LIKE '%.yaml' OR lower(path) LIKE '%.yml') AND contains(content, 'apiVersion:') "
    "AND contains(content, 'kind:') THEN 'kubernetes' END"
)
BLOB_OK = (
    f"strlen(content) <= {fv.MAX_BLOB_BYTES} AND (NOT contains(content, chr(0)) OR strlen(split_part(content, chr(0), 1)) >= {fv.NUL_PROBE_BYTES})"
)


def lines_ctes(units: str, max_chars: int | None = None) -> str:
    limit = f"WHERE length(line) <= {max_chars}" if max_chars else ""
    return (
        f"units AS ({units}), "
        f"marked AS (SELECT *, {FILE_TYPE} AS file_type, {IAC_TARGET} AS iac_target, "
        f"string_split(content, chr(10)) AS ls FROM units), "
        "numbered AS (SELECT repo_id, path, commit_id, ts, file_type, iac_target, "
        "unnest(ls) AS line, unnest(list_concat([NULL], ls[:-2])) AS prev_line, "
        "unnest(range(1, len(ls) + 1))::INTEGER AS line_no FROM marked), "
        f"lines AS (SELECT * FROM numbered {limit})"
    )


# --- matches ------------------------------------------------------------------------

REDACT = (
    "CASE WHEN length(m) <= 8 THEN repeat('*', length(m)) "
    "ELSE left(m, 4) || repeat('*', length(m) - 8) || right(m, 4) END"
)
DATE_LIKE = "regexp_matches(trim(m), " + lit("|".join(fv.DATE_PATTERNS)) + ")"
DIGITS = "regexp_replace(m, '[\\s-]', '', 'g')"


def luhn(d: str) -> str:
    return (
        f"(regexp_full_match({d}, '\\d{{13,19}}') AND list_sum(list_transform(range(1, length({d}) + 1), "
        f"lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN substr({d}, i, 1)::INT "
        f"WHEN substr({d}, i, 1)::INT < 5 THEN 2 * substr({d}, i, 1)::INT "
        f"ELSE 2 * substr({d}, i, 1)::INT - 9 END)) % 10 = 0)"
    )


def issuer(d: str) -> str:
    n, p2, p4, p6 = (f"length({d})", f"left({d},2)::INT", f"left({d},4)::INT", f"left({d},6)::INT")
    return (
        f"(CASE WHEN left({d},1) = '4' THEN {n} IN (13,16,19) "
        f"WHEN {p2} IN (34,37) AND {n} = 15 THEN true "
        f"WHEN ({p2} BETWEEN 51 AND 55 OR {p4} BETWEEN 2221 AND 2720) AND {n} = 16 THEN true "
        f"WHEN ({p4} = 6011 OR {p2} = 65 OR {p4} BETWEEN 6440 AND 6499 OR {p6} BETWEEN 622126 AND 622925) AND {n} IN (16,19) THEN true "
        f"WHEN ({p4} BETWEEN 3000 AND 3059 OR {p4} = 3095 OR {p2} IN (36,38,39)) AND {n} BETWEEN 14 AND 19 THEN true "
        f"WHEN {p4} BETWEEN 3528 AND 3589 AND {n} BETWEEN 16 AND 19 THEN true "
        f"WHEN {p2} = 62 AND {n} BETWEEN 16 AND 19 THEN true "
        f"WHEN ({p2} = 50 OR {p2} BETWEEN 56 AND 69) AND {n} BETWEEN 12 AND 19 THEN true ELSE false END)"
    )


def entropy(t: str) -> str:
    return (
        f"list_sum(list_transform(list_distinct(string_split({t}, '')), lambda ch: "
        f"- ((length({t}) - length(replace({t}, ch, ''))) / length({t})) "
        f"* log2((length({t}) - length(replace({t}, ch, ''))) / length({t}))))"
    )


IBAN = "upper(regexp_replace(m, '\\s', '', 'g'))"
IBAN_OK = (
    f"(MAP {{{', '.join(f'{lit(k)}: {v}' for k, v in fv.IBAN_LENGTHS.items())}}}[left({IBAN}, 2)] = length({IBAN}) "
    f"AND list_reduce(list_transform(string_split(array_to_string(list_transform("
    f"string_split(substr({IBAN}, 5) || left({IBAN}, 4), ''), "
    f"lambda ch: CASE WHEN ch BETWEEN 'A' AND 'Z' THEN (ascii(ch) - 55)::VARCHAR ELSE ch END), ''), ''), "
    f"lambda d: d::INT), lambda acc, d: (acc * 10 + d) % 97, 0) = 1)"
)


def plain_values(values, upper: bool) -> list[str]:
    out = [v.replace(" ", "").replace("-", "") for v in values]
    return [v.upper() for v in out] if upper else out


def mail_is_test(config: ScanConfig) -> str:
    f = config.mail_filter
    if not f.enabled:
        return "false"

    def known(defaults, extra):
        return strings(sorted({*defaults, *(e.lower() for e in extra)}))

    domain = "split_part(lower(m), '@', 2)"
    labels = f"string_split({domain}, '.')"
    return (
        f"(list_contains({known(fv.TEST_MAIL_ADDRESSES, f.addresses)}, lower(m)) "
        f"OR list_has_any(string_split_regex(split_part(lower(m), '@', 1), '[._+-]'), {known(fv.TEST_MAIL_LOCAL_PARTS, f.local_parts)}) "
        f"OR list_contains({known(fv.TEST_MAIL_DOMAINS, f.domains)}, {domain}) "
        f"OR list_contains({known(fv.TEST_MAIL_TLDS, f.tlds)}, {labels}[-1]) "
        f"OR coalesce(list_contains({known(fv.TEST_MAIL_SLDS, f.slds)}, {labels}[-2]), false))"
    )


RAW_COLUMNS = (
    "repo_id, detector_id, category, severity, rule_id, path, line_no, redacted_match, commit_id, ts, verified"
)


def _select(detector, category, severity, rule_id, source, accept="true") -> str:
    return (
        f"SELECT repo_id, {lit(detector)} AS detector_id, {lit(category)} AS category, {lit(severity)} AS severity, "
        f"{lit(rule_id)} AS rule_id, path, line_no, {REDACT} AS redacted_match, commit_id, ts, "
        f"false AS verified, line, prev_line FROM ({source}) WHERE {accept}"
    )


def _matches(pattern: str, where: str = "true", first_only: bool = False) -> str:
    found = f"regexp_extract_all(line, {lit(pattern)})"
    if first_only:
        found += "[:1]"
    return f"SELECT *, unnest({found}) AS m FROM lines WHERE {where}"


def card_source() -> str:
    p = lit(fv.CARD_PATTERN)
    return (
        "SELECT *, ms[j] AS m, "
        "CASE WHEN ps[j] <> '' THEN right(ps[j], 1) WHEN j > 1 THEN right(ms[j - 1], 1) ELSE '' END AS before, "
        "CASE WHEN ps[j + 1] <> '' THEN left(ps[j + 1], 1) WHEN j < len(ms) THEN left(ms[j + 1], 1) ELSE '' END AS after "
        "FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM (SELECT *, "
        f"regexp_extract_all(line, {p}) AS ms, string_split_regex(line, {p}) AS ps FROM lines "
        f"WHERE file_type <> 'BINARY' AND regexp_matches(line, {p})))"
    )


CARD_EDGE = "NOT regexp_matches(before, '[A-Fa-f-]') AND NOT regexp_matches(after, '[A-Fa-f-]')"


def card_accept(config: ScanConfig) -> str:
    allowed = plain_values(config.allowed_cards, False)
    return (
        f"NOT {DATE_LIKE} AND {CARD_EDGE} AND {luhn(DIGITS)} "
        f"AND len(list_distinct(string_split({DIGITS}, ''))) > 1 AND {issuer(DIGITS)} "
        f"AND NOT {in_list(DIGITS, allowed)}"
    )


def phone_ctes() -> str:
    """Phone matches without look-around: every possible start, its longest fitting
    end, and of overlapping ones the leftmost, chosen by recursion."""
    body = "\\+?\\d[\\d ()/-]{7,16}\\d"
    return (
        "phone_lines AS (SELECT row_number() OVER () AS lid, * FROM lines "
        f"WHERE file_type <> 'BINARY' AND regexp_matches(line, {lit(body)})), "
        "phone_starts AS (SELECT lid, line, unnest(range(1, length(line) + 1)) AS s FROM phone_lines), "
        "phone_spans AS (SELECT lid, s, max(s + n) AS e FROM (SELECT lid, line, s, unnest(range(9, 20)) AS n "
        "FROM phone_starts WHERE regexp_matches(substr(line, s, 1), '[+\\d]') "
        "AND (s = 1 OR NOT regexp_matches(substr(line, s - 1, 1), '[\\w.]'))) "
        f"WHERE s + n - 1 <= length(line) AND regexp_full_match(substr(line, s, n), {lit(body)}) "
        "AND NOT regexp_matches(substr(line, s + n, 1), '[\\w.]') GROUP BY lid, s), "
        "phone_found(lid, s, e) AS (SELECT lid, min(s), arg_min(e, s) FROM phone_spans GROUP BY lid "
        "UNION ALL SELECT p.lid, min(p.s), arg_min(p.e, p.s) FROM phone_found f JOIN phone_spans p "
        "ON p.lid = f.lid AND p.s >= f.e GROUP BY p.lid, f.s), "
        "phone_matches AS (SELECT l.*, substr(l.line, f.s, f.e - f.s) AS m FROM phone_found f JOIN phone_lines l USING (lid))"
    )


def detector_selects(config: ScanConfig) -> list[str]:
    out = []
    if "secrets" in config.groups:
        for r in config.secret_rules:
            if config.active(r.rule_id):
                out.append(
                    _select(fv.SECRET_RULES_DETECTOR, "SECRET", config.severity(r.rule_id, r.severity), r.rule_id, _matches(r.pattern))
                )
        if config.entropy and config.active(fv.ENTROPY_RULE):
            e = config.entropy
            out.append(
                _select(
                    fv.ENTROPY_DETECTOR, "SECRET", config.severity(fv.ENTROPY_RULE, e.severity), fv.ENTROPY_RULE,
                    _matches(fv.ENTROPY_TOKEN), f"length(m) >= {e.min_length} AND {entropy('m')} >= {e.threshold}",
                )
            )
    if "pii" in config.groups:
        wanted = set(config.pii_patterns)
        text_file = "file_type <> 'BINARY'"
        allowed = plain_values(config.allowed_ibans, True)
        forms = {
            "iban": (_matches(fv.IBAN_PATTERN, text_file), f"NOT {DATE_LIKE} AND {IBAN_OK} AND NOT {in_list(IBAN, allowed)}"),
            "creditcard": (card_source(), card_accept(config)),
            "email": (_matches(fv.EMAIL_PATTERN, text_file), f"NOT {DATE_LIKE} AND NOT {mail_is_test(config)}"),
            "phone": (
                "SELECT * FROM phone_matches",
                f"NOT {DATE_LIKE} AND length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15",
            ),
        }
        for r in fv.PII_RULES:
            default_on = r.rule_id in wanted if wanted else r.rule_id not in fv.PII_DEFAULT_OFF
            if config.active(r.rule_id, default_on):
                source, accept = forms[r.rule_id]
                out.append(_select(fv.PII_DETECTOR, "PII", config.severity(r.rule_id, r.severity), r.rule_id, source, accept))
        for r in config.custom_rules:
            if config.active(r.rule_id):
                out.append(
                    _select(fv.CUSTOM_REGEX_DETECTOR, "PII", config.severity(r.rule_id, r.severity), r.rule_id, _matches(r.pattern, text_file))
                )
    if "iac" in config.groups:
        for r in config.iac_rules:
            if r.target in config.iac_targets and config.active(r.rule_id):
                where = f"iac_target = {lit(r.target)} AND file_type IN ('CONFIG', 'OTHER')"
                out.append(
                    _select(fv.IAC_DETECTOR, "IAC", config.severity(r.rule_id, r.severity), r.rule_id, _matches(r.pattern, where, True))
                )
    return out


def _directive(line: str, names: list[str], require_reason: bool) -> str:
    p = lit(fv.DIRECTIVE_PATTERN)
    reason = "AND regexp_matches(z[2], '\\S')" if require_reason else ""
    return (
        f"len(list_filter(list_zip(regexp_extract_all(coalesce({line}, ''), {p}, 1), "
        f"regexp_extract_all(coalesce({line}, ''), {p}, 2)), "
        f"lambda z: {in_list('z[1]', names)} {reason})) > 0"
    )


def suppressed(require_reason: bool = False) -> str:
    return (
        f"({_directive('line', ['ignore-line'], require_reason)} "
        f"OR {_directive('prev_line', ['ignore-next-line'], require_reason)} "
        f"OR (category = 'SECRET' AND {_directive('line', ['ignore-secret'], require_reason)}) "
        f"OR (category = 'PII' AND {_directive('line', ['ignore-pii'], require_reason)}))"
    )


def findings_ctes(units: str, config: ScanConfig, name: str = "raw") -> str:
    selects = " UNION ALL ".join(detector_selects(config))
    phone = f"{phone_ctes()}, " if "phone_matches" in selects else ""
    return (
        f"{lines_ctes(units)}, {phone}hits AS ({selects}), "
        f"{name} AS (SELECT {RAW_COLUMNS} FROM hits WHERE NOT {suppressed(config.require_reason)})"
    )


# --- aggregated findings ------------------------------------------------------------

RANK = f"(list_position({strings(fv.SEVERITIES)}, severity) - 1)::INTEGER"
FINGERPRINT = "sha256(rule_id || ':' || path || ':' || line_no || ':' || redacted_match)[1:16]"


def aggregate_ctes(source: str = "raw", name: str = "agg") -> str:
    first = "arg_min({}, {{'a': ts, 'b': commit_id, 'c': detector_id, 'd': severity, 'e': verified}})"
    picked = ", ".join(
        f"{first.format(c)} AS {c}"
        for c in (
            "detector_id", "category", "severity", "rule_id", "path", "line_no", "redacted_match",
            "verified", "commit_id",
        )
    )
    return (
        f"printed AS (SELECT *, {FINGERPRINT} AS fingerprint FROM {source}), "
        f"grouped AS (SELECT repo_id, fingerprint, {picked}, min(ts) AS first_seen, max(ts) AS last_seen, "
        "count(*) AS occurrences FROM printed GROUP BY repo_id, fingerprint), "
        f"{name} AS (SELECT repo_id, fingerprint, detector_id, category, severity, {RANK} AS severity_rank, rule_id, "
        "path, line_no, redacted_match, verified, commit_id, first_seen, last_seen, occurrences, "
        "false AS suppressed, false AS baseline FROM grouped)"
    )


def with_query(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"
