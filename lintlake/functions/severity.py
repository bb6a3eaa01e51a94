"""Severity scales."""

from __future__ import annotations

from pyspark.sql import Column

from lintlake.functions.sqltext import chain, evaluate, quote

# Ordinal, score and vector of each severity.
RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
CVSS = {
    "CRITICAL": (9.0, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"),
    "HIGH": (7.5, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N"),
    "MEDIUM": (5.3, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N"),
    "LOW": (3.7, "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:L/I:N/A:N"),
    "INFO": (0.0, None),
}


def rank_sql(severity: str) -> str:
    return chain([(f"{severity} = '{s}'", str(rank)) for s, rank in RANK.items()], "NULL")


def cvss_score_sql(severity: str) -> str:
    return chain([(f"{severity} = '{s}'", f"{score}D") for s, (score, _) in CVSS.items()], "NULL")


def cvss_vector_sql(severity: str) -> str:
    return chain([(f"{severity} = '{s}'", quote(vector)) for s, (_, vector) in CVSS.items()], "NULL")


def severity_rank(severity: Column | str) -> Column:
    return evaluate(rank_sql, severity=severity)


def cvss_score(severity: Column | str) -> Column:
    return evaluate(cvss_score_sql, severity=severity)


def cvss_vector(severity: Column | str) -> Column:
    return evaluate(cvss_vector_sql, severity=severity)


def sarif_level(severity: Column | str) -> Column:
    return evaluate(lambda severity: f"IF({severity} IN ('CRITICAL', 'HIGH'), 'error', 'warning')", severity=severity)
