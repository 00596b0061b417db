"""The rules, lists and limits every result depends on.

Everything in this file is data. The values are fixed by the behaviour to match
and are written out plainly; no logic lives here.
"""

from __future__ import annotations

from typing import NamedTuple

# --- Fixed values: ordered enumerations ----------------------------------------

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")
CATEGORIES = ("SECRET", "PII", "LICENSE", "IAC", "CUSTOM")
FILE_TYPES = ("SOURCE", "CONFIG", "DOCUMENTATION", "BINARY", "OTHER")
TRIAGE_STATUSES = ("OPEN", "BASELINE", "SUPPRESSED", "FALSE_POSITIVE")
SCAN_STATUSES = ("QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED")
REMEDIATION_STATUSES = ("OPEN", "PR_OPEN", "FIXED", "ROTATED", "SCRUBBED")

# --- Fixed values: limits -------------------------------------------------------

MAX_LINE_CHARS = 4000
MAX_BLOB_BYTES = 2000000
NUL_PROBE_BYTES = 8000
ENTROPY_THRESHOLD = 4.5
ENTROPY_MIN_LENGTH = 20
VALUE_MIN_LENGTH = 4
PAGE_LIMIT_DEFAULT = 100
PAGE_LIMIT_MAX = 500
REPORT_ROWS = 50
RECENT_SCANS = 500

# --- Fixed values: file extensions per file type --------------------------------

SOURCE_EXTENSIONS = (
    "java", "kt", "ts", "js", "py", "go", "rb", "cs", "cpp", "c", "rs", "php", "scala",
)
CONFIG_EXTENSIONS = ("yaml", "yml", "json", "toml", "properties", "xml", "env", "ini", "conf")
DOCUMENTATION_EXTENSIONS = ("md", "txt", "adoc", "rst")
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "pdf", "zip", "jar", "class", "ico", "woff", "woff2",
)

# --- Fixed values: detector ids and groups --------------------------------------

SECRET_RULES_DETECTOR = "secret.regex-ruleset"
ENTROPY_DETECTOR = "secret.high-entropy"
PII_DETECTOR = "pii.patterns"
CUSTOM_REGEX_DETECTOR = "pii.custom-regex"
VALUES_DETECTOR = "pii.customer-data-api"
IAC_DETECTOR = "iac.misconfig"

GROUP_OF_CATEGORY = {
    "SECRET": "secrets",
    "PII": "pii",
    "LICENSE": "license",
    "IAC": "iac",
    "CUSTOM": "custom",
}

# --- Fixed values: word boundary ------------------------------------------------
# The ASCII word boundary, spelled out because the JDK's own \b also looks at
# accented letters.

ASCII_BOUNDARY = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


class Rule(NamedTuple):
    """A pattern rule. ``anchors`` are literals of which one must occur before
    ``pattern`` can match; ``hint`` is a cheap pattern with the same meaning;
    ``line_bound`` is false for patterns that match a whole text wherever they match
    one of its lines. The three only save time."""

    rule_id: str
    description: str
    pattern: str
    severity: str
    target: str | None = None
    anchors: tuple[str, ...] = ()
    hint: str | None = None
    line_bound: bool = True


# --- Fixed values: secret rules -------------------------------------------------

SECRET_RULES = (
    Rule(
        "aws-access-key-id",
        "AWS Access Key ID",
        r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}",
        "HIGH",
        anchors=("A3T", "AKIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA"),
    ),
    Rule(
        "gcp-api-key",
        "Google Cloud API Key",
        r"AIza[0-9A-Za-z\-_]{35}",
        "HIGH",
        anchors=("AIza",),
    ),
    Rule(
        "azure-storage-account-key",
        "Azure Storage Account Key",
        r"(?i)AccountKey\s*=\s*[A-Za-z0-9+/]{86}==",
        "HIGH",
        hint=r"=\s*[A-Za-z0-9+/]{86}==",
        anchors=("==",),
    ),
    Rule(
        "github-personal-access-token",
        "GitHub Personal Access Token",
        r"ghp_[0-9A-Za-z]{36}",
        "HIGH",
        anchors=("ghp_",),
    ),
    Rule(
        "github-fine-grained-pat",
        "GitHub Fine-Grained Personal Access Token",
        r"github_pat_[0-9A-Za-z_]{82}",
        "HIGH",
        anchors=("github_pat_",),
    ),
    Rule(
        "slack-token",
        "Slack Token",
        r"xox[baprs]-[0-9A-Za-z\-]{10,48}",
        "HIGH",
        anchors=("xox",),
    ),
    Rule(
        "private-key",
        "Private Key Block",
        r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----",
        "CRITICAL",
        anchors=("PRIVATE KEY-----",),
    ),
    Rule(
        "generic-api-key",
        "Generic API Key assignment",
        r"(?i)(?:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*['\"][0-9A-Za-z\-_]{16,64}['\"]",
        "MEDIUM",
        hint=r"[:=]\s*['\"][0-9A-Za-z\-_]{16,64}['\"]",
    ),
)

# --- Fixed values: infrastructure rules -----------------------------------------

IAC_RULES = (
    Rule(
        "tf-public-acl",
        "Terraform: bucket or ACL readable by the public",
        r'(?i)acl\s*=\s*"public-read(-write)?"',
        "HIGH",
        "terraform",
        line_bound=False,
    ),
    Rule(
        "tf-open-ingress",
        "Terraform: ingress from the whole internet (0.0.0.0/0)",
        r'cidr_blocks\s*=\s*\[\s*"0\.0\.0\.0/0"',
        "HIGH",
        "terraform",
        line_bound=False,
    ),
    Rule(
        "tf-unencrypted",
        "Terraform: encryption switched off",
        r"(?i)encrypted\s*=\s*false",
        "MEDIUM",
        "terraform",
        line_bound=False,
    ),
    Rule(
        "k8s-privileged",
        "Kubernetes: privileged container",
        r"(?i)privileged:\s*true",
        "HIGH",
        "kubernetes",
        line_bound=False,
    ),
    Rule(
        "k8s-run-as-root",
        "Kubernetes: runAsNonRoot is false",
        r"(?i)runAsNonRoot:\s*false",
        "MEDIUM",
        "kubernetes",
        line_bound=False,
    ),
    Rule(
        "k8s-host-network",
        "Kubernetes: hostNetwork is on",
        r"(?i)hostNetwork:\s*true",
        "MEDIUM",
        "kubernetes",
        line_bound=False,
    ),
    Rule(
        "docker-user-root",
        "Dockerfile: runs as root",
        r"(?im)^\s*USER\s+root\s*$",
        "MEDIUM",
        "dockerfile",
        line_bound=False,
    ),
    Rule(
        "docker-latest-tag",
        "Dockerfile: unpinned :latest base image",
        r"(?im)^\s*FROM\s+\S+:latest\b",
        "LOW",
        "dockerfile",
        line_bound=False,
    ),
)

IAC_TARGETS = ("terraform", "kubernetes", "dockerfile")

# --- Fixed values: entropy and personal-data patterns ---------------------------

ENTROPY_RULE = "high-entropy-string"
ENTROPY_TOKEN = r"[A-Za-z0-9+/=_-]{16,}"

IBAN_PATTERN = r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b"
CARD_PATTERN = r"\b(?:\d[ -]?){13,19}\b"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_PATTERN = r"(?<![\w.])\+?\d[\d ()/-]{7,16}\d(?![\w.])"

PII_RULES = (
    Rule("iban", "PII pattern: iban", IBAN_PATTERN, "HIGH", hint=r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}"),
    Rule("creditcard", "PII pattern: creditcard", CARD_PATTERN, "HIGH", hint=r"\d(?:[ -]?\d){12}"),
    Rule("email", "PII pattern: email", EMAIL_PATTERN, "MEDIUM", anchors=("@",)),
    Rule("phone", "PII pattern: phone", PHONE_PATTERN, "MEDIUM", hint=r"\d[\d ()/-]{7}"),
)
PII_DEFAULT_OFF = ("phone",)

DATE_PATTERNS = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{1,2}(?::\d{2}(?::\d{2})?)?)?$",
    r"^\d{1,2}[./]\d{1,2}[./]\d{2,4}(?:[T ]\d{1,2}(?::\d{2}(?::\d{2})?)?)?$",
    r"^\d{1,2}:\d{2}(?::\d{2})?$",
)

# --- Fixed values: inline directives --------------------------------------------

DIRECTIVE_PATTERN = (
    r"scanner:(ignore-secret|ignore-pii|ignore-line|ignore-next-line)"
    r'(?:\s+reason="([^"]*)")?'
)
DIRECTIVE_MARK = "scanner:ignore-"
APPEND_MARK = "<<APPEND>>"
REMOVED_MARK = "***REMOVED***"

# --- Fixed values: word tokens ---------------------------------------------------

WORD_TOKEN = r"[\p{L}\p{Nd}_]+"
NON_WORD_RUN = r"[^\p{L}\p{Nd}_]+"

# --- Fixed values: IBAN length per country (ISO 13616 registry) -------------------

IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22,
    "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# --- Fixed values: well-known test accounts and cards -----------------------------

ALLOWED_IBANS = (
    "CH93 0076 2011 6238 5295 7",
    "DE89 3704 0044 0532 0130 00",
    "GB29 NWBK 6016 1331 9268 19",
    "FR14 2004 1010 0505 0001 3M02 606",
    "IT60 X054 2811 1010 0000 0123 456",
    "ES91 2100 0418 4502 0005 1332",
    "NL91 ABNA 0417 1643 00",
    "AT61 1904 3002 3457 3201",
    "BE68 5390 0754 7034",
    "LI21 0881 0000 2324 013A A",
    "SE45 5000 0000 0583 9825 7466",
    "NO93 8601 1117 947",
    "PL61 1090 1014 0000 0712 1981 2874",
)

ALLOWED_CARDS = (
    "4111 1111 1111 1111",
    "4242 4242 4242 4242",
    "4012 8888 8888 1881",
    "4000 0566 5566 5556",
    "5555 5555 5555 4444",
    "5105 1051 0510 5100",
    "2223 0031 2200 3222",
    "5200 8282 8282 8210",
    "3782 822463 10005",
    "3714 496353 98431",
    "6011 1111 1111 1117",
    "6011 0009 9013 9424",
    "3056 9300 0902 0004",
    "3530 1113 3330 0000",
)

# --- Fixed values: test and placeholder mail addresses ----------------------------

TEST_MAIL_TLDS = (
    "test", "invalid", "localhost", "example", "internal", "local", "localdomain",
    "intranet", "corp", "lan", "home", "private", "onion", "alt",
)

TEST_MAIL_SLDS = (
    "example", "beispiel", "exemple", "ejemplo", "esempio", "exemplo", "voorbeeld",
    "eksempel", "przyklad", "domain", "yourdomain", "mydomain", "company", "mycompany",
    "yourcompany", "acme", "contoso", "fabrikam", "adventure-works", "northwindtraders",
    "tailspintoys", "wingtiptoys", "litware", "proseware",
)

TEST_MAIL_DOMAINS = (
    "googletest.com", "resend.dev", "test.com", "mailinator.com", "mailtrap.io",
    "ethereal.email", "mailsac.com", "maildrop.cc", "inboxkitten.com", "yopmail.com",
    "guerrillamail.com", "10minutemail.com", "temp-mail.org", "tempmail.com",
    "trashmail.com", "throwawaymail.com", "getnada.com", "sharklasers.com",
    "dispostable.com", "fakeinbox.com", "mailnesia.com", "mintemail.com",
    "mailcatch.com", "emailondeck.com", "mohmal.com", "spam4.me",
)

TEST_MAIL_LOCAL_PARTS = (
    "test", "tester", "testuser", "testaccount", "testperson", "testing", "test123",
    "dummy", "dummyuser", "fixture", "example", "sample", "demo", "placeholder", "fake",
    "changeme", "donotuse", "nobody", "foo", "bar", "baz", "qux", "lorem", "ipsum",
    "asdf", "qwerty", "mustermann", "musterfrau", "musterkunde", "maxmustermann",
    "erika", "erikamustermann", "johndoe", "janedoe", "jdoe", "jsmith", "joebloggs",
    "qa", "e2e", "staging", "robot", "bot", "automation", "selenium", "cypress",
    "playwright", "noreply", "no-reply", "donotreply", "do-not-reply",
)

TEST_MAIL_ADDRESSES = (
    "mail@mail.com", "email@email.com", "name@email.com", "user@email.com",
    "youremail@gmail.com", "your.email@gmail.com", "example@gmail.com", "a@a.com",
    "x@x.com", "foo@bar.com",
)

# Number ranges of card schemes by their first digits, and the lengths of a number.
CARD_RANGES = (
    (4, 4, (13, 16, 19)),
    (34, 34, (15,)),
    (37, 37, (15,)),
    (51, 55, (16,)),
    (2221, 2720, (16,)),
    (6011, 6011, (16, 19)),
    (65, 65, (16, 19)),
    (6440, 6499, (16, 19)),
    (622126, 622925, (16, 19)),
    (3000, 3059, (14, 15, 16, 17, 18, 19)),
    (3095, 3095, (14, 15, 16, 17, 18, 19)),
    (36, 36, (14, 15, 16, 17, 18, 19)),
    (38, 39, (14, 15, 16, 17, 18, 19)),
    (3528, 3589, (16, 17, 18, 19)),
    (62, 62, (16, 17, 18, 19)),
    (50, 50, (12, 13, 14, 15, 16, 17, 18, 19)),
    (56, 69, (12, 13, 14, 15, 16, 17, 18, 19)),
)
