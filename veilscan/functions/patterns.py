"""From rules to match expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from veilscan.functions import fixed_values as fv
from veilscan.functions.fixed_values import Rule


def spark_pattern(pattern: str) -> str:
    """The pattern with its word boundaries spelled out for ASCII words."""
    return re.sub(
        r"(?<!\\)((?:\\\\)*)\\b", lambda m: m.group(1) + fv.ASCII_BOUNDARY, pattern
    )


def sql_text(value: str) -> str:
    """A string literal for SQL expressions."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Iterable[str]) -> Column:
    """A constant array; given as one expression, however long the list."""
    items = ", ".join(sql_text(v) for v in values)
    return F.expr(f"cast(array({items}) as array<string>)")


def among(value: Column, values: Iterable[str]) -> Column:
    return F.array_contains(text_array(values), value)


def all_matches_sql(column: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({column}, {sql_text(spark_pattern(pattern))}, {group})"


def all_matches(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(value, F.lit(spark_pattern(pattern)), F.lit(group))


def any_sql(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def may_match_sql(column: str, rule: Rule, whole_text: bool = False) -> str:
    """Cheap test that holds for every text the rule matches in: literals first,
    found on the bytes, then the hint. A rule without either is tested by its own
    pattern; on a whole text only if the pattern means the same there as on a line."""
    tests = []
    if rule.anchors:
        tests.append(any_sql(f"contains({column}, {sql_text(a)})" for a in rule.anchors))
    if rule.hint:
        tests.append(f"({column} rlike {sql_text(rule.hint)})")
    if not tests and not (whole_text and rule.line_bound):
        tests.append(f"({column} rlike {sql_text(spark_pattern(rule.pattern))})")
    return " AND ".join(tests) if tests else "true"


def with_context(pattern: str) -> str:
    """Groups 1, 2, 3: the character before a match, the match, the one after."""
    core = pattern.removeprefix(r"\b").removesuffix(r"\b")
    b = fv.ASCII_BOUNDARY
    return rf"(?<=([\s\S])|^){b}({core}){b}(?=([\s\S])|$)"


def glob_pattern(glob: str) -> str:
    """A path glob as an anchored regular expression.

    ``*`` and ``?`` stay within a folder, ``**`` crosses folders, ``[…]`` is a
    character class and ``{a,b}`` a choice. A leading ``**/`` also matches at the
    root.
    """
    body = _glob_body(glob)
    if glob.startswith("**/"):
        body = f"(?:{body}|{_glob_body(glob[3:])})"
    return f"^{body}$"


def _glob_body(glob: str) -> str:
    out: list[str] = []
    i = 0
    in_choice = False
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end]
            negated = body.startswith("!")
            body = body.removeprefix("!").replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            if body.startswith("^"):
                body = "\\" + body
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
            i = end
        elif c == "{":
            out.append("(?:")
            in_choice = True
        elif c == "}" and in_choice:
            out.append(")")
            in_choice = False
        elif c == "," and in_choice:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if in_choice:
        raise ValueError(f"unclosed choice in glob {glob!r}")
    return "".join(out)
