"""Counts, statistics and scores over finding tables.

Every rollup reads its input once and counts before it shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.schema import FINDING_TYPES, SEVERITIES

# Weight of a finding in the risk score, and the score's ceiling.
RISK_WEIGHTS = {"CRITICAL": 100, "HIGH": 50, "MEDIUM": 20, "LOW": 5}
MAX_RISK = 100


def count_by(findings: DataFrame, col: str) -> DataFrame:
    return findings.groupBy(col).agg(F.count("*").alias("findings"))


def _weight(severity: Column) -> Column:
    found = F.lit(0)
    for name, weight in RISK_WEIGHTS.items():
        found = F.when(severity == name, weight).otherwise(found)
    return found


def _with_files(findings: DataFrame, files: DataFrame, *keep: str) -> DataFrame:
    """Findings and files in one table, so that one aggregation sees both.

    Only `keep` is read from the findings, and nothing but a marker from the files.
    """
    marks = files.select(*[F.lit(None).cast("string").alias(c) for c in keep], F.lit(1).alias("is_file"))
    return findings.select(*keep, F.lit(0).alias("is_file")).unionAll(marks)


def _files_count() -> Column:
    return F.coalesce(F.sum("is_file"), F.lit(0))


def _risk() -> Column:
    total = F.coalesce(F.sum(_weight(F.col("severity"))), F.lit(0))
    score = total / F.greatest(_files_count(), F.lit(1))
    return F.round(F.least(score, F.lit(float(MAX_RISK))), 2)


def risk_score(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: severity-weighted findings per file, at most 100."""
    return _with_files(findings, files, "severity").agg(_risk().alias("risk_score"))


def finding_counts() -> list[Column]:
    """How many findings there are, and of each severity and type: to aggregate, or to observe while they are written."""
    kinds = [("severity", v) for v in SEVERITIES] + [("finding_type", v) for v in FINDING_TYPES]
    return [F.count("*").alias("findings"), *[F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, v in kinds]]


def _metrics(counts: DataFrame) -> DataFrame:
    """One row of run metrics, of one row of `finding_counts`, `files` and `errors`."""

    def histogram(col: str, values: tuple[str, ...]) -> Column:
        pairs = [F.struct(F.lit(v).alias("key"), F.col(f"{col}_{v}").alias("value")) for v in values]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"] > 0))

    files = F.greatest("files", F.lit(1))
    weighted = sum((F.col(f"severity_{name}") * weight for name, weight in RISK_WEIGHTS.items()), F.lit(0))
    return counts.select(
        F.col("findings").alias("total_findings"),
        histogram("severity", SEVERITIES).alias("by_severity"),
        histogram("finding_type", FINDING_TYPES).alias("by_type"),
        F.round(F.least(weighted / files, F.lit(float(MAX_RISK))), 2).alias("risk_score"),
        F.col("files").alias("files_scanned"),
        F.round(F.col("findings") / files, 2).alias("findings_per_file"),
        F.col("errors").cast("int").alias("errors"),
    )


def run_metrics(findings: DataFrame, files: DataFrame, errors: DataFrame | int = 0) -> DataFrame:
    """One row of run metrics; counts by severity and type are maps without zeros.

    `errors` is a number, or a table with a row for each error.
    """
    both = _with_files(findings, files, "severity", "finding_type")
    found = F.col("is_file") == 0
    counts = [F.count_if(found).alias("findings"), *finding_counts()[1:]]
    counted = both.agg(*counts, _files_count().alias("files"))
    if isinstance(errors, DataFrame):
        return _metrics(counted.crossJoin(F.broadcast(errors.agg(F.count("*").alias("errors")))))
    return _metrics(counted.withColumn("errors", F.lit(errors)))


def metrics_of(spark: SparkSession, counts: dict[str, int], files: int, errors: int) -> DataFrame:
    """Run metrics of what was observed during a run."""
    row = {**counts, "files": files, "errors": errors}
    return _metrics(spark.createDataFrame([tuple(row.values())], ", ".join(f"`{name}` long" for name in row)))


def summary(findings: DataFrame) -> DataFrame:
    """(stat, key, findings): the total and both histograms."""
    grouped = findings.groupingSets(
        [[F.col("severity")], [F.col("finding_type")], []], F.col("severity"), F.col("finding_type")
    ).agg(F.count("*").alias("findings"), F.grouping_id().alias("g"))
    stat = F.when(F.col("g") == 0b01, "severity").when(F.col("g") == 0b10, "finding_type").otherwise("total")
    return grouped.select(stat.alias("stat"), F.coalesce("severity", "finding_type").alias("key"), "findings")


# What the statistics of each kind count by key, and of what they count the distinct values; SQL texts.
COUNTED = {
    "vulnerability": {"severity": "severity", "cwe": "cwe", "owasp": "owasp", "category": "coalesce(category, 'other')"},
    "dependency": {"severity": "severity", "cve": "cve"},
    "quality": {"rule": "rule_id"},
}
DISTINCT = {
    "vulnerability": {"files_affected": "file"},
    "dependency": {"packages_affected": "package"},
    "quality": {"files_affected": "file"},
}


def stats_state(findings: DataFrame, kind: str) -> DataFrame:
    """(stat, key, n): how often each key occurs in a run, to be stored and merged with other runs'.

    Keys of distinct counts are kept as they are, so merged counts are exact.  Every partition counts its own keys
    before they are shuffled.
    """
    pairs = [*COUNTED[kind].items(), *DISTINCT[kind].items(), ("total", "''")]
    structs = [f"named_struct('stat', '{stat}', 'key', CAST({key} AS STRING))" for stat, key in pairs]
    exploded = findings.select(F.explode(F.expr(f"array({', '.join(structs)})")).alias("p")).filter(F.col("p.key").isNotNull())
    return exploded.groupBy("p.stat", "p.key").agg(F.count("*").alias("n"))


def merge_stats(*states: DataFrame) -> DataFrame:
    """The state of all runs together: counts of a key are added up."""
    return reduce(DataFrame.unionByName, states).groupBy("stat", "key").agg(F.sum("n").alias("n"))


def stats_of(state: DataFrame, kind: str) -> DataFrame:
    """(stat, key, findings): counts per key, distinct values and the total of a state."""
    is_distinct = F.col("stat").isin(list(DISTINCT[kind]))
    key = F.when(~is_distinct & (F.col("stat") != "total"), F.col("key"))
    return state.groupBy("stat", key.alias("key")).agg(
        F.sum(F.when(is_distinct, F.lit(1)).otherwise(F.col("n"))).cast("bigint").alias("findings")
    )


def stats_sketch(findings: DataFrame, kind: str) -> DataFrame:
    """One row: sketches of the distinct values, of a size that does not depend on their number."""
    return findings.agg(*[F.hll_sketch_agg(F.expr(f"CAST({key} AS STRING)")).alias(stat) for stat, key in DISTINCT[kind].items()])


def merge_sketches(kind: str, *sketches: DataFrame) -> DataFrame:
    """One row: about how many distinct values all runs have together."""
    union = reduce(DataFrame.unionByName, sketches)
    return union.agg(*[F.hll_sketch_estimate(F.hll_union_agg(stat)).alias(stat) for stat in DISTINCT[kind]])


def vuln_stats(findings: DataFrame) -> DataFrame:
    """Counts by severity, cwe, owasp and category, and the files affected."""
    return stats_of(stats_state(findings, "vulnerability"), "vulnerability")


def dep_stats(findings: DataFrame) -> DataFrame:
    """Counts by severity and cve, and the packages affected."""
    return stats_of(stats_state(findings, "dependency"), "dependency")


def quality_stats(findings: DataFrame) -> DataFrame:
    """Counts by rule, and the files affected."""
    return stats_of(stats_state(findings, "quality"), "quality")
