"""Writing findings: JSON, CSV, text lines and SARIF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.functions.severity import sarif_level, severity_rank
from lintlake.operators.hits import canonical
from lintlake.support import small_table, stored

# Fixed values of the SARIF format.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0-rtm.5.json"
_TOOL_VERSION = "1.0.0"

_FRAME = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())])


def report(findings: DataFrame) -> DataFrame:
    """The short form of a finding used in JSON reports."""
    return findings.select(
        "id", "rule_id", "severity", "file", "line", "message", F.col("code_snippet").alias("code")
    )


def _flat(findings: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    return findings.select(
        *[
            F.to_json(f.name).alias(f.name)
            if f.dataType.typeName() in ("array", "map", "struct")
            else F.col(f.name)
            for f in findings.schema.fields
        ]
    )


def write_findings(
    findings: DataFrame,
    path: str,
    format: str = "json",
    metrics: DataFrame | None = None,
    full: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Write findings under `path`; run metrics, if given, under `<path>_metrics`.

    `full` writes every column to JSON instead of the short report form.
    """
    if format == "json":
        (canonical(findings) if full else report(findings)).write.mode(mode).json(path)
    elif format == "csv":
        _flat(canonical(findings)).write.mode(mode).option("escape", '"').csv(path, header=True)
    elif format == "parquet":
        canonical(findings).write.mode(mode).parquet(path)
    elif format == "text":
        to_text(findings).select("line_text").write.mode(mode).text(path)
    elif format == "sarif":
        write_sarif(findings, path, mode)
    else:
        raise ValueError(f"unknown format: {format}")
    if metrics is not None:
        metrics.write.mode(mode).json(f"{path}_metrics")


def to_text(findings: DataFrame) -> DataFrame:
    """`[SEV] message (file:line)` and the shorter `[SEV] rule - file:line`."""
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    level = F.concat(F.lit("["), F.col("severity"), F.lit("] "))
    return findings.select(
        "severity",
        "file",
        "line",
        F.concat(level, "message", F.lit(" ("), place, F.lit(")")).alias("line_text"),
        F.concat(level, "rule_id", F.lit(" - "), place).alias("short_text"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """The fields of a SARIF result, one row per finding."""
    return findings.select(
        "rule_id",
        sarif_level("severity").alias("level"),
        "message",
        F.col("file").alias("uri"),
        F.col("line").alias("start_line"),
        F.col("column").alias("start_column"),
    )


def _order(findings: DataFrame):
    """Place of a finding in a report, as one comparable value."""
    return F.struct(
        (-severity_rank("severity")).alias("r"), F.col("file"), F.col("line"), F.col("rule_id"), F.col("column")
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row per rule with findings, described by its first finding."""
    at = _order(findings)
    return findings.groupBy("rule_id").agg(
        F.min(at).alias("at"),
        F.min_by("message", at).alias("message"),
        F.min_by(F.array_join("remediations", "\n"), at).alias("help"),
    )


def _with_commas(entries: DataFrame) -> DataFrame:
    """A comma before every entry but the first."""
    first = entries.agg(F.min(F.struct("at", "number"))).scalar()
    comma = F.when(F.struct("at", "number") == first, F.lit("")).otherwise(F.lit(","))
    return entries.withColumn("text", F.concat(comma, "text"))


def to_sarif(findings: DataFrame, tool: str = "lintlake") -> DataFrame:
    """One SARIF log as ordered text lines: (part, at, number, text).

    Sorted by (part, at, number) and joined, the lines are one JSON document.  It is
    never held in one place: every result is its own line.  All but the first
    entry of a list carry the comma in front.  The findings are read once: what the log says of each is written to the
    shared folder, with a number that tells equal ones apart, and the rest works on that.
    """
    place = F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
        F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region"),
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        sarif_level("severity").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
    )
    help_text = F.array_join("remediations", "\n").alias("help")
    slim = findings.select("rule_id", "message", help_text, _order(findings).alias("at"), F.to_json(result).alias("text"))
    entries = stored(slim.withColumn("number", F.monotonically_increasing_id()), "sarif")
    results = entries.select(F.lit(3).alias("part"), "at", "number", "text")
    first = F.struct("at", "number")
    of_rule = entries.groupBy("rule_id").agg(F.min(first).alias("first"), F.min_by("message", first).alias("message"), F.min_by("help", first).alias("help"))
    rules = of_rule.select(
        F.lit(1).alias("part"),
        "first.at",
        "first.number",
        F.to_json(
            F.struct(
                F.col("rule_id").alias("id"),
                F.struct(F.col("message").alias("text")).alias("shortDescription"),
                F.struct(F.coalesce("help", F.lit("")).alias("text")).alias("help"),
            )
        ).alias("text"),
    )
    marked = _with_commas(rules).unionAll(_with_commas(results))
    head = f'{{"version":"{SARIF_VERSION}","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":'
    head += f'{{"name":"{tool}","version":"{_TOOL_VERSION}","rules":['
    frame = [(0, head), (2, ']}},"results":['), (4, "]}]}")]
    rows = [{"part": part, "text": text} for part, text in frame]
    at = F.lit(None).cast(marked.schema["at"].dataType).alias("at")
    fixed = small_table(findings.sparkSession, rows, _FRAME).select("part", at, F.lit(0).cast("long").alias("number"), "text")
    return marked.unionAll(fixed)


def write_sarif(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text parts that, read in name order, are one SARIF document."""
    to_sarif(findings).orderBy("part", "at", "number").select("text").write.mode(mode).text(path)
