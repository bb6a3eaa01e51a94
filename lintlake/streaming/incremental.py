"""Scanning files as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.builtin.tables import LANGUAGE_OF_EXTENSION, MANIFEST_NAMES, MANIFEST_SUFFIX
from lintlake.operators.dependencies import dependencies, dependency_findings, manifests, match_advisories
from lintlake.operators.findings import union_findings
from lintlake.operators.hits import canonical
from lintlake.plans.scan import Options, file_findings, selected_files
from lintlake.sources.files import files_table
from lintlake.sources.tables import builtin_advisories
from lintlake.support import checkpoint_root


def stream_files(
    spark: SparkSession, path: str, extensions: Iterable[str] | None = None, files_per_batch: int = 10_000
) -> DataFrame:
    """A stream of the files that appear under a folder, dependency manifests included.

    However old a file is when it appears, it is read.  Spark's file source passes over empty files and over names
    that begin with a dot or an underscore; land such a tree as a table to scan them.
    """
    extensions = list(LANGUAGE_OF_EXTENSION if extensions is None else extensions)
    names = [*("*" + e for e in extensions), *MANIFEST_NAMES, "*" + MANIFEST_SUFFIX]
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(names) + "}")
        .option("maxFileAge", "100000d")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return files_table(raw)


def scan_stream(
    files: DataFrame,
    rules: DataFrame | None = None,
    watermark: str = "1 day",
    options: Options = Options(),
    **changes,
) -> DataFrame:
    """Findings of a stream of files (file, code, language), with `seen_at`, the time they were found.

    The same detectors as in a batch scan, dependencies included.  Times are those of arrival, so files may come in
    any order of age.  A finding that comes again within the watermark is given once; older ids are forgotten,
    which bounds the state.
    """
    options = Options(**{**options.__dict__, **changes})
    found = file_findings(selected_files(files, options), rules, options).drop("seq")
    if options.dependencies:
        known = builtin_advisories(files.sparkSession).filter(F.col("severity").isin(options.severities()))
        matched = match_advisories(dependencies(manifests(files)), known, options.version_mode)
        found = union_findings(found, dependency_findings(matched, options.now).drop("seq"))
    timed = canonical(found).withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", watermark)
    return timed.dropDuplicatesWithinWatermark(["id"])


def run_available(findings: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Append the findings of everything that has arrived so far to a table."""
    spark = findings.sparkSession
    checkpoint = checkpoint or f"{checkpoint_root(spark)}/scan-{uuid.uuid4().hex}"
    query = (
        findings.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
