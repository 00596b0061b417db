"""Text expressions: severity ranks, masking, fingerprints, paths, tokens, entropy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilscan.functions import fixed_values as fv


def severity_rank(severity: Column) -> Column:
    """INFO=0 … CRITICAL=4; null for anything else."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(fv.SEVERITIES):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in fv.SEVERITIES]), (rank + 1).cast("int"))


def at_least(severity: Column, threshold: str) -> Column:
    """Ordinal comparison: is ``severity`` the threshold or worse?"""
    return severity.isin(list(fv.SEVERITIES[fv.SEVERITIES.index(threshold):]))


def category_group(category: Column) -> Column:
    group = F.lit(None).cast("string")
    for name, value in fv.GROUP_OF_CATEGORY.items():
        group = F.when(category == name, F.lit(value)).otherwise(group)
    return group


def redact(value: Column) -> Column:
    """First and last four characters stay, the rest becomes ``*``; short values
    are masked whole; null gives the empty string."""
    n = F.length(value)
    return (
        F.when(value.isNull(), F.lit(""))
        .when(n <= 8, F.repeat(F.lit("*"), n))
        .otherwise(
            F.concat(
                F.substring(value, 1, 4),
                F.repeat(F.lit("*"), n - 8),
                F.substring(value, -4, 4),
            )
        )
    )


def mask_sample(value: Column) -> Column:
    """Two visible characters, for samples of value sources."""
    n = F.length(value)
    return (
        F.when(value.isNull(), F.lit(""))
        .when(n <= 2, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 2)))
    )


def fingerprint(rule_id: Column, path: Column, line_no: Column, redacted: Column) -> Column:
    """16 hex characters naming a finding; commit and repository are not part of it."""
    basis = F.concat_ws(":", rule_id, path, line_no.cast("string"), redacted)
    return F.substring(F.sha2(basis, 256), 1, 16)


def file_type(path: Column) -> Column:
    lower = F.lower(path)
    ext = F.when(lower.contains("."), F.substring_index(lower, ".", -1)).otherwise(F.lit(""))
    return (
        F.when(ext.isin(*fv.SOURCE_EXTENSIONS), F.lit("SOURCE"))
        .when(ext.isin(*fv.CONFIG_EXTENSIONS), F.lit("CONFIG"))
        .when(ext.isin(*fv.DOCUMENTATION_EXTENSIONS), F.lit("DOCUMENTATION"))
        .when(ext.isin(*fv.BINARY_EXTENSIONS), F.lit("BINARY"))
        .otherwise(F.lit("OTHER"))
    )


def file_extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty when the name has no dot."""
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def facet_extension(path: Column) -> Column:
    """Text after the last dot anywhere, else the whole path (finding-list facet)."""
    return F.substring_index(path, ".", -1)


def path_target(path: Column) -> Column:
    """What the path says: terraform, dockerfile, yaml or null."""
    p = F.lower(path)
    name = F.substring_index(p, "/", -1)
    return (
        F.when(p.endswith(".tf") | p.endswith(".tf.json"), F.lit("terraform"))
        .when(
            (name == "dockerfile") | name.startswith("dockerfile.") | name.endswith(".dockerfile"),
            F.lit("dockerfile"),
        )
        .when(p.endswith(".yaml") | p.endswith(".yml"), F.lit("yaml"))
    )


def looks_kubernetes(content: Column) -> Column:
    return content.contains("apiVersion:") & content.contains("kind:")


def iac_target(path: Column, content: Column) -> Column:
    """terraform / dockerfile / kubernetes, or null for other files."""
    target = path_target(path)
    return F.when(target != "yaml", target).when(
        (target == "yaml") & looks_kubernetes(content), F.lit("kubernetes")
    )


def tokens(line: Column) -> Column:
    """Runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(line, F.lit(fv.WORD_TOKEN), F.lit(0))


def value_hash(value: Column, pepper: str = "") -> Column:
    """Hex SHA-256 of pepper followed by value; null gives the empty string."""
    return F.when(value.isNull(), F.lit("")).otherwise(
        F.sha2(F.concat(F.lit(pepper), value), 256)
    )


def shannon_entropy(token: Column) -> Column:
    """Bits per character."""
    n = F.length(token).cast("double")
    chars = F.array_distinct(F.split(token, ""))

    def add(total: Column, char: Column) -> Column:
        p = (n - F.length(F.replace(token, char, F.lit("")))) / n
        return total - p * F.log2(p)

    return F.aggregate(chars, F.lit(0.0), add)


def normalise_pii(value: Column, upper: bool) -> Column:
    """Spaces and hyphens out; accounts in upper case."""
    plain = F.regexp_replace(value, r"[\s-]", "")
    return F.upper(plain) if upper else plain


def blank_to_null(value: Column) -> Column:
    return F.when(value.rlike(r"\S"), F.trim(value))


def sarif_level(severity: Column) -> Column:
    return (
        F.when(severity.isNull(), F.lit("warning"))
        .when(severity.isin("CRITICAL", "HIGH"), F.lit("error"))
        .when(severity == "MEDIUM", F.lit("warning"))
        .otherwise(F.lit("note"))
    )


def build_log_level(severity: Column) -> Column:
    return (
        F.when(severity.isin("CRITICAL", "HIGH"), F.lit("ERROR"))
        .when(severity == "MEDIUM", F.lit("WARNING"))
        .otherwise(F.lit("INFO"))
    )


def build_log_escape(value: Column) -> Column:
    """The ``|`` escapes of build-log service messages."""
    out = F.coalesce(value, F.lit(""))
    for char, code in (("|", "||"), ("'", "|'"), ("\n", "|n"), ("\r", "|r"), ("[", "|["), ("]", "|]")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out
