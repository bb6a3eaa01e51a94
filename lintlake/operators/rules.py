"""Rule tables: normalisation, validation, selection and statistics."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.builtin.rules import RULES as BUILTIN
from lintlake.functions.patterns import compiles, java_pattern, matches_empty, translatable
from lintlake.schema import RULES, SEVERITIES

_REQUIRED = ("id", "name", "description", "pattern", "severity", "language")


def _problem(pattern: str | None) -> str | None:
    if pattern is None:
        return None
    if not compiles(pattern):
        return "pattern does not compile"
    if not translatable(pattern):
        return "pattern has a construct without a counterpart"
    return "pattern can match nothing" if matches_empty(pattern) else None


# Rules that share a pattern are common: a worker looks at each pattern once.
@lru_cache(1 << 16)
def _judged(pattern: str | None) -> tuple[str | None, str | None]:
    problem = _problem(pattern)
    return problem, None if problem or pattern is None else java_pattern(pattern)


# This runs on one row per rule, never per file.
@F.pandas_udf(T.StructType([T.StructField("problem", T.StringType()), T.StructField("java", T.StringType())]))
def _translated(patterns: pd.Series) -> pd.DataFrame:
    judged = [_judged(pattern) for pattern in patterns]
    return pd.DataFrame({"problem": [p for p, _ in judged], "java": [j for _, j in judged]}, dtype=object)


def with_java(rules: DataFrame, problem: str = "problem") -> DataFrame:
    """The rules with their pattern as the JVM takes it in `java`, or null and what is wrong with it.

    The JVM itself compiles every pattern: it lacks a few constructs that compile in Python.
    """
    judged = rules.withColumn("_java", _translated("pattern"))
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.coalesce("_java.java", F.lit("")))
    refused = F.col("_java.java").isNotNull() & compiled.isNull()
    return judged.withColumns(
        {
            "java": F.when(~refused, F.col("_java.java")),
            problem: F.coalesce("_java.problem", F.when(refused, F.lit("pattern has a construct without a counterpart"))),
        }
    ).drop("_java")


def with_defaults(rule: dict) -> dict:
    """A rule as given on the driver, with the fields a table would hold."""
    full = {f.name: rule.get(f.name) for f in RULES.fields}
    for name, fold in (("severity", str.upper), ("language", str.lower)):
        if full[name] is not None:
            full[name] = fold(full[name])
    if "message_template" not in rule:
        full["message_template"] = full["description"]
    full["references"] = full["references"] or []
    full["tags"] = full["tags"] or []
    full["enabled"] = True if full["enabled"] is None else full["enabled"]
    full["category"] = full["category"] or "security"
    return full


def builtin_rule_rows() -> list[dict]:
    return list(map(with_defaults, BUILTIN))


def normalise_rules(rules: DataFrame) -> DataFrame:
    """Fold case, fill defaults and bring the columns into the fixed schema."""
    have = set(rules.columns)
    full = rules.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RULES.fields
        ]
    )
    no_texts = F.array().cast("array<string>")
    return full.withColumns(
        {
            "severity": F.upper("severity"),
            "language": F.lower("language"),
            "message_template": F.coalesce("message_template", "description"),
            "references": F.coalesce("references", no_texts),
            "tags": F.coalesce("tags", no_texts),
            "enabled": F.coalesce("enabled", F.lit(True)),
            "category": F.coalesce("category", F.lit("security")),
        }
    )


def validate_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rules, rejected rules with a `reason`).

    Of several otherwise valid rules with one id the first by name and pattern
    stays.
    """
    missing = F.lit(None).cast("string")
    for name in reversed(_REQUIRED):
        missing = F.when(F.col(name).isNull(), F.lit(f"missing {name}")).otherwise(missing)
    bad_severity = F.when(~F.col("severity").isin(*SEVERITIES), F.lit("unknown severity"))
    own = F.coalesce(missing, bad_severity, "_problem")
    rank = F.row_number().over(
        Window.partitionBy("id").orderBy(F.col("reason").isNotNull(), "name", "pattern")
    )
    # A rule table is often a single small file: dealt by id, its patterns are looked at in many tasks.
    judged = with_java(rules.repartition("id"), "_problem").withColumn("reason", own).drop("_problem", "java").withColumn("_rank", rank)
    reason = F.coalesce("reason", F.when(F.col("_rank") > 1, F.lit("duplicate id")))
    judged = judged.withColumn("reason", reason).drop("_rank")
    ok = judged.filter(F.col("reason").isNull()).drop("reason")
    return ok, judged.filter(F.col("reason").isNotNull())


def filter_rules(
    rules: DataFrame,
    languages: list[str] | None = None,
    severities: list[str] | None = None,
    categories: list[str] | None = None,
    tags: list[str] | None = None,
    enabled_only: bool = True,
) -> DataFrame:
    """Rules that meet every given criterion (any of the tags)."""
    if enabled_only:
        rules = rules.filter("enabled")
    if languages:
        rules = rules.filter(F.col("language").isin([x.lower() for x in languages]))
    if severities:
        rules = rules.filter(F.col("severity").isin([x.upper() for x in severities]))
    if categories:
        rules = rules.filter(F.col("category").isin([x.lower() for x in categories]))
    if tags:
        wanted = F.array(*[F.lit(x.lower()) for x in tags])
        rules = rules.filter(F.arrays_overlap(F.transform("tags", F.lower), wanted))
    return rules


def rules_for_language(rules: DataFrame, language: str) -> DataFrame:
    return rules.filter(F.col("language") == language.lower())


def rule_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.filter(F.col("id") == rule_id)


def set_enabled(rules: DataFrame, ids: list[str], flag: bool) -> DataFrame:
    """The same rules with `enabled` set on the named ones."""
    return rules.withColumn("enabled", F.when(F.col("id").isin(ids), F.lit(flag)).otherwise(F.col("enabled")))


def rule_stats(rules: DataFrame) -> DataFrame:
    """(stat, key, rules): totals and counts by language, severity and category."""
    grouped = rules.groupingSets(
        [[F.col("language")], [F.col("severity")], [F.col("category")], [F.col("enabled")], []],
        F.col("language"),
        F.col("severity"),
        F.col("category"),
        F.col("enabled"),
    ).agg(F.count("*").alias("rules"), F.grouping_id().alias("g"))
    # Bits of the grouping id: language, severity, category, enabled.
    stat = (
        F.when(F.col("g") == 0b0111, "language")
        .when(F.col("g") == 0b1011, "severity")
        .when(F.col("g") == 0b1101, "category")
        .when(F.col("g") == 0b1110, F.when(F.col("enabled"), "enabled").otherwise("disabled"))
        .otherwise("total")
    )
    return grouped.select(stat.alias("stat"), F.coalesce("language", "severity", "category").alias("key"), "rules")
