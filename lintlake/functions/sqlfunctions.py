"""The detectors' functions for SQL: temporary functions of a session, made from the texts of the Column functions.

Patterns are those of Spark's own `RLIKE`; a pattern matches line by line and across lines, and its classes know all
of Unicode, as in the Column functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lintlake.functions.identity import finding_id_sql
from lintlake.functions.matching import MATCHES, find_sql, last_line_sql, newlines_sql, snippet_sql, strip_sql
from lintlake.functions.severity import cvss_score_sql, rank_sql
from lintlake.functions.versions import comparable_sql, range_sql

_FLAGS = "'(?dUms)'"


def _regex(pattern: str) -> str:
    return f"concat({_FLAGS}, {pattern})"


def _covers_sql(version: str, spec: str) -> str:
    have, bound = comparable_sql(version), range_sql(spec)
    return (
        f"coalesce(IF({bound}.below, {have} < {bound}.key OR ({bound}.inclusive AND {have} = {bound}.key), "
        f"{have} = {bound}.key), false)"
    )


# Name, parameters, type of the result, and its text.
FUNCTIONS = [
    ("find_matches", "code STRING, pattern STRING", MATCHES, find_sql("code", _regex("pattern"))),
    ("count_matches", "code STRING, pattern STRING", "INT", f"regexp_count(code, {_regex('pattern')})"),
    ("has_pattern", "code STRING, pattern STRING", "BOOLEAN", f"code RLIKE {_regex('pattern')}"),
    ("function_calls", "code STRING, name STRING", MATCHES, find_sql("code", _regex(r"concat('\\b\\Q', name, '\\E\\s*\\(')"))),
    ("line_of", "code STRING, offset INT", "INT", f"{newlines_sql('left(code, offset)')} + 1"),
    ("column_of", "code STRING, offset INT", "INT", f"{last_line_sql('left(code, offset)')} + 1"),
    ("snippet", "code STRING, line INT", "STRING", snippet_sql("split(code, chr(10), -1)", "line")),
    ("strip_text", "value STRING", "STRING", strip_sql("value")),
    ("finding_id", "file STRING, line INT, rule_id STRING", "STRING", finding_id_sql("file", "line", "rule_id")),
    ("severity_rank", "severity STRING", "INT", rank_sql("severity")),
    ("cvss_score", "severity STRING", "DOUBLE", cvss_score_sql("severity")),
    ("version_covered", "version STRING, spec STRING", "BOOLEAN", _covers_sql("version", "spec")),
]


def register(spark: SparkSession, prefix: str = "lint_") -> list[str]:
    """Makes the functions known to the session's SQL, as `lint_find_matches` and so on; returns their names."""
    for name, parameters, kind, text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {text}")
    return [prefix + name for name, *_ in FUNCTIONS]
