"""Operators on finding tables: union, deduplication, order, selection, advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.builtin.tables import DEFAULT_REMEDIATION
from lintlake.functions.severity import RANK, cvss_score, cvss_vector, severity_rank
from lintlake.operators.hits import TYPE_OF

_KEY = ("file", "line", "rule_id")


def union_findings(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def dedup(findings: DataFrame) -> DataFrame:
    """One finding per (file, line, rule_id): the first by analyzer and match order.

    The rank is filtered to 1, so Spark drops later duplicates before the
    shuffle and a hot key sends one row per input partition.
    """
    arrival = F.lit(len(TYPE_OF))
    for analyzer, name in TYPE_OF.items():
        arrival = F.when(F.col("finding_type") == name, analyzer).otherwise(arrival)
    order = [arrival] + [F.col(c) for c in ("seq", "column", "message") if c in findings.columns]
    ranked = findings.withColumn("_rank", F.row_number().over(Window.partitionBy(*_KEY).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank", "seq")


def ordered(findings: DataFrame) -> DataFrame:
    """Severest first, then by file, line, rule and column."""
    return findings.orderBy(severity_rank("severity").desc(), "file", "line", "rule_id", "column")


def min_severity(findings: DataFrame, level: str = "LOW") -> DataFrame:
    return findings.filter(severity_rank("severity") >= RANK[level.upper()])


def by_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity") == severity.upper())


def by_type(findings: DataFrame, finding_type: str) -> DataFrame:
    return findings.filter(F.col("finding_type") == finding_type)


def critical(findings: DataFrame) -> DataFrame:
    return by_severity(findings, "CRITICAL")


def high(findings: DataFrame) -> DataFrame:
    return by_severity(findings, "HIGH")


def has_critical(findings: DataFrame) -> DataFrame:
    """One row: whether any finding is critical."""
    return findings.agg(
        F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).alias("has_critical")
    )


def with_remediations(findings: DataFrame, cwe_table: DataFrame) -> DataFrame:
    """Advice per finding: the rule's own first, then that of its weakness class."""
    texts = cwe_table.select(F.upper("cwe").alias("_cwe"), F.col("texts").alias("_texts"))
    none = F.array().cast("array<string>")
    own = F.when(F.length("remediation") > 0, F.array("remediation")).otherwise(none)
    advice = F.concat(own, F.coalesce("_texts", none))
    joined = findings.join(texts, F.upper("cwe") == F.col("_cwe"), "left")
    return joined.withColumn(
        "remediations", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(DEFAULT_REMEDIATION)))
    ).drop("_cwe", "_texts")


def with_cvss(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"cvss": cvss_score("severity"), "cvss_vector": cvss_vector("severity")})
