"""Operators on file tables."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.builtin.tables import DEPENDENCY_LANGUAGES, EXCLUDE_PATTERNS, SUPPORTED_LANGUAGES
from lintlake.functions.patterns import java_pattern

_MIB = 1024 * 1024


def _glob_regex(pattern: str) -> str:
    """Regex of the shell glob `*pattern*`; `*` crosses folders."""
    # The translation ends in an atomic group per star, which Java reads alike.
    return fnmatch.translate(f"*{pattern}*")


def is_excluded(file: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether a path matches any of the globs anywhere."""
    if not patterns:
        return F.lit(False)
    either = "|".join(f"(?:{java_pattern(_glob_regex(p), multiline=False)})" for p in patterns)
    return F.rlike(file, F.lit(f"^(?:{either})"))


def exclude_paths(files: DataFrame, patterns: list[str] | tuple[str, ...] = tuple(EXCLUDE_PATTERNS)) -> DataFrame:
    """Drop files whose path matches any of the globs anywhere."""
    return files.filter(~is_excluded(F.col("file"), patterns)) if patterns else files


def is_supported(language: Column) -> Column:
    return F.lower(language).isin(SUPPORTED_LANGUAGES)


def supported_only(files: DataFrame) -> DataFrame:
    return files.filter(is_supported(F.col("language")))


def fits(code: Column, max_mb: float) -> Column:
    return F.length(code) <= int(max_mb * _MIB)


def limit_size(files: DataFrame, max_mb: float = 10) -> DataFrame:
    """Drop files of more than `max_mb` MiB of characters."""
    return files.filter(fits(F.col("code"), max_mb))


def relative_paths(table: DataFrame, root: str, col: str = "file") -> DataFrame:
    """Remove the root folder from the displayed path."""
    return table.withColumn(col, F.replace(F.col(col), F.lit(root)))


def files_by_language(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(language, file), to be read or written by language.

    A language can hold most of all files, so the files of a language stay rows
    and are not collected into a list.
    """
    if languages:
        files = files.filter(F.col("language").isin(languages))
    return files.select("language", "file")


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def language_info(extensions: DataFrame) -> DataFrame:
    """Per language: its extensions and what is done for it."""
    grouped = extensions.groupBy(F.lower("language").alias("name")).agg(
        F.sort_array(F.collect_set("ext")).alias("extensions")
    )
    return grouped.withColumns(
        {
            "supported": F.col("name").isin(SUPPORTED_LANGUAGES),
            "has_dependency_analysis": F.col("name").isin(DEPENDENCY_LANGUAGES),
        }
    )
