"""The whole analysis as one lazy plan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lintlake.builtin.rules import SECRET_RULES
from lintlake.builtin.tables import MANIFEST_NAMES, MANIFEST_SUFFIX
from lintlake.functions.severity import RANK
from lintlake.operators.dependencies import (
    WHOLE_HIT,
    base_name,
    dependencies,
    dependency_findings,
    entries_of,
    entry_hits_sql,
    is_manifest,
    match_advisories,
)
from lintlake.operators.dependencies import manifests as manifests_of
from lintlake.operators.files import exclude_paths, fits, is_excluded, is_supported
from lintlake.operators.findings import dedup, ordered, union_findings
from lintlake.operators.hits import (
    DEPENDENCY,
    ERROR,
    NO_HITS,
    SAST,
    SECRET,
    canonical,
    concat_sql,
    dedup_hits,
    explode_hits,
    findings_of,
    first_per_line_sql,
    hit_sql,
    info_table,
    union_hits,
)
from lintlake.operators.quality import quality_hits_sql, quality_info_rows, quality_marks_sql
from lintlake.operators.rollups import finding_counts, metrics_of, run_metrics
from lintlake.operators.rule_index import candidates, matching_sql, rule_blocks
from lintlake.operators.rules import builtin_rule_rows, filter_rules, with_java
from lintlake.operators.sast import (
    NO_MARKS,
    indexed_hits,
    marked_hits_sql,
    rule_info,
    rule_info_rows,
    rule_marks_sql,
    with_folded,
)
from lintlake.operators.secrets import ANY, secret_blocks, secret_info, secret_info_rows, secret_marks_sql
from lintlake.schema import SEVERITIES
from lintlake.sources.files import read_files
from lintlake.sources.tables import builtin_advisories
from lintlake.support import spread


@dataclass(frozen=True)
class Options:
    """What to scan for.  By default no path is left out; `EXCLUDE_PATTERNS` has the stock patterns.

    languages          scan only these; None for every supported language
    exclude            path globs to leave out; None for none
    max_mb             largest text, in MiB of characters
    severity           least severity reported
    secrets, quality   switch these detectors off
    dependencies       switch the advisory lookup off
    version_mode       `semantic` or `string` version comparison
    unique_files       every `file` names one row, as in a listing: duplicates
                       then only arise within a row and need no shuffle
    order              sort the result
    now                time of the run, for first_seen and last_seen
    """

    languages: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    max_mb: float = 10
    severity: str = "LOW"
    secrets: bool = True
    quality: bool = True
    dependencies: bool = True
    version_mode: str = "semantic"
    unique_files: bool = False
    order: bool = True
    now: datetime | str | None = None

    def severities(self) -> list[str]:
        return [s for s in SEVERITIES if RANK[s] >= RANK[self.severity.upper()]]


def selected_files(files: DataFrame, options: Options) -> DataFrame:
    """The files a run covers, the unsupported ones included."""
    kept = exclude_paths(files, options.exclude) if options.exclude else files
    if options.languages:
        kept = kept.filter(F.lower("language").isin([x.lower() for x in options.languages]))
    return kept


def _is_selected(options: Options) -> Column:
    selected = ~is_excluded(F.col("file"), options.exclude or ())
    if options.languages:
        selected = selected & F.lower("language").isin([x.lower() for x in options.languages])
    return selected


def all_hits(
    files: DataFrame,
    rules: DataFrame | None = None,
    options: Options = Options(),
    secret_patterns: DataFrame | None = None,
    keep: Iterable[str] = (),
    entries: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(exploded hits of all per-file detectors, rule data for them).

    All detectors run in one projection, so every file is read once; a rule table of several blocks takes a further
    pass for each.  Rules below the wanted severity are not run at all; a rule has one severity, so
    this equals filtering their findings.  Without `rules` the built-in ones run.  `keep` names further columns of the
    files to carry along.  With `entries` the dependencies of manifests come as hits of their own, and files that
    cannot be scanned as rows of the analyzer `ERROR`: see `file_errors`.
    """
    spark = files.sparkSession
    wanted = options.severities()
    scanned = _is_selected(options) & is_supported(F.col("language"))
    files = files.withColumn("language", F.lower("language"))
    needed = files.select("file", "code", "language", *keep, F.coalesce(scanned, F.lit(False)).alias("_selected"))
    usable = needed.withColumn("_scan", F.col("_selected") & F.coalesce(fits(F.col("code"), options.max_mb), F.lit(False)))
    if entries:
        usable = usable.withColumns({"_manifest": is_manifest(F.col("file")) & F.col("code").isNotNull(), "base_name": base_name(F.col("file"))})
        usable = usable.filter("_selected OR _manifest")
    else:
        usable = usable.filter("_scan")
    usable = spread(usable)
    blocks: list[list] = []
    secret_rules: list[list] = []
    marks: list[str] = []
    parts: list[str] = []
    info: list[dict] = []
    if rules is None:
        rows = [r for r in builtin_rule_rows() if r["severity"] in wanted]
        marks.append(rule_marks_sql("code", "language", rows))
        info += rule_info_rows(rows)
    else:
        rules = filter_rules(rules, severities=wanted)
        blocks = list(rule_blocks(rules))
    if options.secrets:
        if secret_patterns is None:
            patterns = [r for r in SECRET_RULES if r["severity"] in wanted]
            marks.append(secret_marks_sql("code", patterns))
            info += secret_info_rows(patterns)
        else:
            secret_patterns = secret_patterns.filter(F.col("severity").isin(wanted))
            secret_rules = list(secret_blocks(secret_patterns))
    if options.quality:
        marks.append(quality_marks_sql("code", wanted))
        parts += quality_hits_sql("code", "language", wanted)
        info += [r for r in quality_info_rows() if r["severity"] in wanted]
    texts = usable
    if secret_rules:
        texts = texts.withColumn("_secrets", candidates(secret_rules[0], SECRET, files)("code", F.lit(ANY)))
        marks.append(matching_sql("code", "_secrets"))
    if blocks:
        texts = texts.withColumn("_candidates", candidates(blocks[0], SAST, files)("code", "language"))
        marks.append(matching_sql("code", "_candidates"))
    every = f"concat({', '.join(marks)})" if marks else NO_MARKS
    if entries:
        every = f"IF(_scan, {every}, {NO_MARKS})"
        parts = [f"IF(_scan, {concat_sql(parts)}, {NO_HITS})"] if parts else []
        parts += [f"IF(_manifest, {entry_hits_sql('code')}, {NO_HITS})", _ERROR_HITS]
    flags = ("_selected", "_scan", "_manifest", "base_name") if entries else ()
    # The marks are a column of their own: all patterns are tested there, in
    # generated code, and only what occurs reaches the position walk.
    marked = with_folded(texts).select("file", "code", "language", *keep, *flags, F.expr(every).alias("_marks"))
    hits = concat_sql([marked_hits_sql("code", "_marks"), *parts])
    tables = [explode_hits(marked, first_per_line_sql(hits), *keep)]
    tables += [indexed_hits(usable.filter("_scan"), block, True, *keep) for block in blocks[1:]]
    more = secret_rules[1:]
    tables += [indexed_hits(usable.filter("_scan"), block, True, *keep, analyzer=SECRET, language=F.lit(ANY)) for block in more]
    known = info_table(spark, info)
    if secret_rules:
        known = known.unionByName(secret_info(secret_patterns))
    if rules is not None:
        known = known.unionByName(rule_info(rules))
    return union_hits(spark, tables, *[files.schema[name] for name in keep]), known


_ERROR_HITS = (
    f"CASE WHEN _selected AND code IS NULL THEN array({hit_sql('0', repr('unreadable'), ERROR, '0')}) "
    f"WHEN _selected AND NOT _scan THEN array({hit_sql('0', repr('too_large'), ERROR, '0')}) ELSE {NO_HITS} END"
)


def file_errors(hits: DataFrame) -> DataFrame:
    """(file, error): files without a text (`unreadable`), and those over the size limit (`too_large`)."""
    return hits.filter(F.col("analyzer") == ERROR).select("file", F.col("rule_id").alias("error"))


def file_findings(
    files: DataFrame,
    rules: DataFrame | None = None,
    options: Options = Options(),
    secret_patterns: DataFrame | None = None,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Findings of all per-file detectors, one per (row, line, rule); see `all_hits`."""
    hits, info = all_hits(files, rules, options, secret_patterns, keep)
    return findings_of(hits, info, options.now, *keep)


def _findings(
    hits: DataFrame, info: DataFrame, options: Options, advisories: DataFrame | None, deps: DataFrame | None
) -> DataFrame:
    """Findings of unique hits, and of the dependencies."""
    found = hits.filter(F.col("analyzer") < DEPENDENCY).filter(WHOLE_HIT)
    tables = [findings_of(found, info, options.now).drop("seq")]
    if deps is not None:
        known = builtin_advisories(hits.sparkSession) if advisories is None else advisories
        known = known.filter(F.col("severity").isin(options.severities()))
        matched = match_advisories(deps, known, options.version_mode)
        tables.append(dedup(dependency_findings(matched, options.now)))
    return canonical(union_findings(*tables))


def scan(
    files: DataFrame,
    rules: DataFrame | None = None,
    advisories: DataFrame | None = None,
    manifests: DataFrame | None = None,
    secret_patterns: DataFrame | None = None,
    options: Options = Options(),
    **changes,
) -> DataFrame:
    """All findings of a file table: deduplicated, filtered and in report order.

    `files` has (file, code, language).  Rules and advisories default to the
    built-in ones.  Manifests default to those found among the files; their dependencies come out of the same pass
    over the texts as all else.  With `unique_files`, where no shuffle parts the two, the files are read a second time
    for them, and nothing but the manifests is looked at there.
    Options may be given as keywords.
    """
    options = Options(**{**options.__dict__, **changes})
    inside = options.dependencies and manifests is None
    if inside and options.unique_files:
        manifests, inside = manifests_of(files), False
    hits, info = all_hits(files, rules, options, secret_patterns, entries=inside)
    if not options.unique_files:
        hits = dedup_hits(hits)
    elif options.order:
        # Sorting samples its input first; without a shuffle in between that
        # would scan the texts twice.
        hits = hits.repartition("file")
    deps = entries_of(hits) if inside else dependencies(manifests) if options.dependencies else None
    everything = _findings(hits, info, options, advisories, deps)
    return ordered(everything) if options.order else everything


def scan_tree(spark: SparkSession, path: str, options: Options = Options(), **changes) -> tuple[DataFrame, DataFrame]:
    """(findings, files) of a folder.

    Manifests are read by name, plain ones only directly in the folder.
    """
    options = Options(**{**options.__dict__, **changes})
    files = read_files(spark, path, max_mb=options.max_mb)
    named = read_files(spark, path, [*MANIFEST_NAMES, MANIFEST_SUFFIX], options.max_mb)
    found = manifests_of(named, root=path.removeprefix("file://"))
    return scan(files, manifests=found, options=options), files


def analyse(
    files: DataFrame, rules: DataFrame | None = None, options: Options = Options(), **changes
) -> tuple[DataFrame, DataFrame]:
    """(findings, run metrics).  The metrics count every selected file."""
    options = Options(**{**options.__dict__, **changes})
    found = scan(files, rules, options=options)
    return found, run_metrics(found, selected_files(files, options))


def write_scan(
    files: DataFrame,
    path: str,
    rules: DataFrame | None = None,
    advisories: DataFrame | None = None,
    secret_patterns: DataFrame | None = None,
    options: Options = Options(),
    **changes,
) -> DataFrame:
    """Scans files into `path` and returns the run metrics, one row.

    The texts are read once: their hits are written below `path` first, findings are made of those, and everything is
    counted on the way.  `<path>/findings` has the findings, `<path>/errors` (file, error) one row for every file that
    could not be scanned, and (rule_id, error) for every rule that could not be run: neither ends the scan.
    """
    options = Options(**{**options.__dict__, **changes, "order": False})
    spark = files.sparkSession
    watched = Observation()
    selected = F.count_if(_is_selected(options)).alias("files")
    counted = files.observe(watched, selected)
    hits, info = all_hits(counted, rules, options, secret_patterns, entries=options.dependencies)
    (hits if options.unique_files else dedup_hits(hits)).write.parquet(f"{path}/hits")
    hits = spark.read.schema(hits.schema).parquet(f"{path}/hits")
    errors = file_errors(hits).select("file", F.lit(None).cast("string").alias("rule_id"), "error")
    if rules is not None:
        refused = with_java(rules.filter("enabled")).filter("java IS NULL")
        errors = errors.unionByName(refused.select(F.lit(None).cast("string").alias("file"), F.col("id").alias("rule_id"), F.col("problem").alias("error")))
    failed, found = Observation(), Observation()
    # Files over the size limit are passed over by intent; the others are errors.
    errors.observe(failed, F.count_if(F.col("error") != "too_large").alias("n")).write.parquet(f"{path}/errors")
    everything = _findings(hits, info, options, advisories, entries_of(hits) if options.dependencies else None)
    everything.observe(found, *finding_counts()).write.parquet(f"{path}/findings")
    return metrics_of(spark, found.get, watched.get["files"], failed.get["n"])
