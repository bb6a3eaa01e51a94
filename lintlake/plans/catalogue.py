"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.builtin.rules import RULES
from lintlake.functions import matching as M
from lintlake.functions.identity import finding_id
from lintlake.functions.language import language_by_shebang, language_for_extension, language_of, suffix_of
from lintlake.functions.severity import sarif_level, severity_rank
from lintlake.functions.sqlfunctions import register
from lintlake.functions.sqltext import quote
from lintlake.operators import dependencies as D
from lintlake.operators import duplicates as B
from lintlake.operators import files as P
from lintlake.operators import findings as N
from lintlake.operators import quality as Q
from lintlake.operators import rollups as A
from lintlake.operators import rules as R
from lintlake.operators.duplicates import duplicate_blocks
from lintlake.operators.sast import sast_findings
from lintlake.operators.secrets import secrets
from lintlake.plans.scan import scan, write_scan
from lintlake.plans.views import MANY_ADVISORIES, corpus, manifest_files, many_part_rules, part_rules, table
from lintlake.schema import SEVERITIES
from lintlake.sources import sinks
from lintlake.sources.files import as_files, decode_text, file_digests
from lintlake.sources.tables import (
    builtin_advisories,
    builtin_cwe_remediation,
    load_rules,
)
from lintlake.streaming.incremental import run_available, scan_stream
from lintlake.streaming.lifecycle import lifecycle_stream, merge_lifecycle, merge_sightings
from lintlake.streaming.tracking import Tracker
from lintlake.support import checkpoint_root, explode_once, spread, stored

Query = Callable[[SparkSession, str], DataFrame]

CREDENTIAL = next(r["pattern"] for r in RULES if r["id"] == "owasp-a02-broken-auth-hardcoded-py")
LINK = r'<a href="([^"]*)">([^<]*)</a>'
NOW = "2024-01-01 00:00:00"
BEFORE = "2023-01-01 00:00:00"

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files without a suffix."""
    docs = table(spark, sf_dir, "documents")
    return as_files(docs, F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), "text", F.lit("unknown"))


def _places(findings: DataFrame, *more: str) -> DataFrame:
    return findings.select("file", "line", "column", "rule_id", *more)


def _sast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sast_findings(corpus(spark, sf_dir), None, NOW)


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_findings(P.supported_only(corpus(spark, sf_dir)), NOW)


def _scan(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return scan(corpus(spark, sf_dir), **{"now": NOW, "severity": "INFO", "order": False, **options})


# Matching


@query
def credential_hits(spark, sf_dir):
    found = explode_once(_texts(spark, sf_dir), M.find_matches("text", CREDENTIAL), "m", "doc_id")
    return found.select("doc_id", "m.line", "m.column", F.col("m.text").alias("matched_text"))


@query
def credential_hits_in_sql(spark, sf_dir):
    """The same written in SQL alone, with the functions that a session is given."""
    register(spark)
    return spark.sql(f"""SELECT doc_id, m.line, m.column, m.text AS matched_text
        FROM (SELECT doc_id, lint_find_matches(text, {quote(CREDENTIAL)}) AS found FROM parquet.`{sf_dir}/documents.parquet`)
        LATERAL VIEW OUTER explode(found) AS m WHERE m IS NOT NULL""")


@query
def findings_in_sql(spark, sf_dir):
    """A detector of one's own in SQL: sentences on a line of their own, with id, place and context."""
    register(spark)
    return spark.sql(f"""SELECT file, m.line, m.column, lint_finding_id(file, m.line, 'sentence') AS id,
            lint_snippet(text, m.line) AS snippet, lint_count_matches(m.text, '[a-z]+') AS words
        FROM (SELECT concat('doc/', doc_id) AS file, text, lint_find_matches(text, '^[A-Z][a-z ]+[.]$') AS found
            FROM parquet.`{sf_dir}/documents.parquet`)
        LATERAL VIEW OUTER explode(found) AS m WHERE m IS NOT NULL""")


@query
def word_positions(spark, sf_dir):
    """Positions of a frequent pattern, many matches per text, some across lines."""
    matches = M.find_matches("text", r"[a-z]\.\s+[A-Z]", unicode=False)
    found = explode_once(_texts(spark, sf_dir), matches, "m", "doc_id")
    return found.select("doc_id", "m.line", "m.column", F.col("m.text").alias("matched_text"))


@query
def pattern_count(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return docs.select("doc_id", M.count_matches("text", "the [a-z]+", case_sensitive=False).alias("matches"))


@query
def has_pattern(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", M.has_pattern("html", r'class="ad".*</footer>').alias("found"))


@query
def match_line(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    return lines.select(
        "conv_id",
        "turn",
        (F.col("pos") + 1).alias("line_no"),
        M.match_line("line", r"^[A-Z][a-z]+ .*\.$").alias("matched"),
    )


@query
def capture_groups(spark, sf_dir):
    found = explode_once(table(spark, sf_dir, "pages"), M.extract_groups("html", LINK), "g", "page_id")
    return found.select("page_id", "g.g1", "g.g2")


@query
def function_calls(spark, sf_dir):
    found = explode_once(table(spark, sf_dir, "pages"), M.function_calls("html", "track"), "m", "page_id")
    return found.select("page_id", "m.line", "m.column", "m.text")


@query
def imports(spark, sf_dir):
    files = corpus(spark, sf_dir)
    parts = [
        explode_once(files, M.imports("code", module, "language"), "m", "file").withColumn("module", F.lit(module))
        for module in ("pickle", "fs", "java.util")
    ]
    found = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return found.select("file", "module", "m.line", "m.column", "m.text")


@query
def line_and_column(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("at", F.expr("instr(text, ', ') - 1"))
    return docs.filter("at >= 0").select(
        "doc_id", M.line_of("text", "at").alias("line"), M.column_of("text", "at").alias("column")
    )


@query
def snippet_context(spark, sf_dir):
    shown = M.evaluate(
        lambda found, lines: f"transform({found}, m -> named_struct('line', m.line, "
        f"'snippet', {M.snippet_sql(lines, 'm.line')}))",
        found=M.find_matches("text", CREDENTIAL),
        lines=F.split("text", "\n"),
    )
    found = explode_once(_texts(spark, sf_dir), shown, "m", "doc_id")
    return found.select("doc_id", "m.line", "m.snippet")


@query
def finding_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", finding_id("source", "n_chars", "lang").alias("id"))


@query
def message_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", M.format_message(F.lit("found {match} ({match})"), "lang").alias("message"))


@query
def severity_scales(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    severity = F.expr("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' "
                      "WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'LOW' ELSE 'INFO' END")  # fmt: skip
    scaled = orders.select("o_orderkey", severity.alias("severity"))
    return scaled.select(
        "o_orderkey", severity_rank("severity").alias("rank"), sarif_level("severity").alias("level")
    )


# Files and languages


@query
def decoded_text(spark, sf_dir):
    """Documents as bytes with foreign line ends and malformed bytes."""
    raw = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("concat(X'C328', encode(replace(text, '\n', '\r\n'), 'UTF-8'), X'0DFF')").alias("content"),
    )
    return decode_text(raw).select("doc_id", F.length("code").alias("chars"), F.md5("code").alias("digest"))


@query
def tree_listing(spark, sf_dir):
    """The files of the given tables, with a digest of their content."""
    files = file_digests(spark, sf_dir, extensions=[".parquet"], max_mb=256)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("size"), "digest")


def _page_path():
    return F.regexp_replace("url", "[?#].*$", "")


@query
def language_of_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", suffix_of(_page_path()).alias("suffix"), language_of(_page_path()).alias("language"))


@query
def language_by_first_line(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    program = F.expr("CASE lang WHEN 'en' THEN '#!/usr/bin/env python3' WHEN 'fr' THEN '#!/bin/sh -e' "
                     "WHEN 'de' THEN ' #!/usr/bin/env node' ELSE text END")  # fmt: skip
    code = F.concat_ws("\n", program, F.col("text"))
    return docs.select(
        "doc_id", language_of(F.lit("bin/run"), code).alias("language"), language_by_shebang(code).alias("named")
    )


@query
def extension_lookup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    ext = F.regexp_extract(_page_path(), r"([A-Za-z0-9]+)$", 1)
    return pages.select("page_id", language_for_extension(ext).alias("language"))


@query
def files_by_language(spark, sf_dir):
    return P.files_by_language(corpus(spark, sf_dir), ["python", "java", "markdown"])


@query
def language_counts(spark, sf_dir):
    return P.language_counts(corpus(spark, sf_dir))


@query
def language_info(spark, sf_dir):
    seen = corpus(spark, sf_dir).select(suffix_of("file").alias("ext"), "language")
    info = P.language_info(seen)
    return info.withColumn("extensions", F.array_join("extensions", " "))


@query
def exclude_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file"))
    return P.exclude_paths(pages, ["*.html", "/en/**", "utm_*=feed", "[mw]ww."]).select("page_id")


@query
def size_limit(spark, sf_dir):
    return P.limit_size(_documents(spark, sf_dir), max_mb=0.002).select("file")


@query
def supported_only(spark, sf_dir):
    return P.supported_only(corpus(spark, sf_dir)).select("file", "language")


@query
def relative_paths(spark, sf_dir):
    return P.relative_paths(corpus(spark, sf_dir), "src/").select("doc_id", "file")


# Rules


@query
def rule_hits_by_rule(spark, sf_dir):
    return _sast(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))


@query
def sast_places(spark, sf_dir):
    found = _sast(spark, sf_dir)
    return _places(found, F.col("context")["matched_text"].alias("matched_text"))


@query
def sast_details(spark, sf_dir):
    return _sast(spark, sf_dir).select(
        "id", "rule_id", "file", "line", "column", "severity", "severity_rank", "finding_type", "cwe", "owasp",
        "category", "status", "code_snippet",
    )


@query
def enrich_cvss(spark, sf_dir):
    scored = N.with_cvss(_sast(spark, sf_dir).drop("cvss", "cvss_vector"))
    return scored.select("id", "column", "rule_id", "cvss", "cvss_vector")


@query
def own_rules(spark, sf_dir):
    """A user's rule pack, made from the passages of the benchmark, on the documents."""
    pack = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("passage-"), F.col("item_id").cast("string")).alias("id"),
        F.lit("passage").alias("name"),
        F.lit("A passage of the benchmark").alias("description"),
        F.col("text").alias("pattern"),
        F.lit("high").alias("severity"),
        F.lit("unknown").alias("language"),
    )
    return _places(sast_findings(_documents(spark, sf_dir), load_rules(spark, pack), NOW), "message")


@query
def many_rules(spark, sf_dir):
    """A rule pack with a rule for every part, thousands of them, on the documents."""
    found = sast_findings(_documents(spark, sf_dir), load_rules(spark, many_part_rules(spark, sf_dir)), NOW)
    return _places(found, "severity")


@query
def enrich_remediation(spark, sf_dir):
    rules = part_rules(spark, sf_dir).select(
        "name",
        F.expr("concat('CWE-', CASE length(name) % 4 WHEN 0 THEN '89' WHEN 1 THEN '79' WHEN 2 THEN '22' ELSE '1' END)")
        .alias("cwe"),
        F.expr("CASE WHEN enabled THEN description END").alias("remediation"),
    )
    found = N.with_remediations(rules, builtin_cwe_remediation(spark))
    return found.select("name", F.array_join("remediations", "|").alias("remediations"))


@query
def rules_normalised(spark, sf_dir):
    rules = R.normalise_rules(part_rules(spark, sf_dir))
    return rules.select(
        "id", "name", "severity", "language", "message_template", "enabled", "category",
        F.size("references").alias("references"), F.array_join("tags", ",").alias("tags"),
    )


def _good_rules(spark, sf_dir):
    return R.validate_rules(R.normalise_rules(part_rules(spark, sf_dir)))


@query
def rules_valid(spark, sf_dir):
    return _good_rules(spark, sf_dir)[0].select("id", "name", "severity", "language")


@query
def rules_rejected(spark, sf_dir):
    return _good_rules(spark, sf_dir)[1].select("id", "name", "reason")


@query
def rules_filtered(spark, sf_dir):
    rules = R.normalise_rules(part_rules(spark, sf_dir))
    kept = R.filter_rules(rules, ["PYTHON", "java"], ["critical", "LOW"], ["economy", "Promo"], ["Widget", "cold"])
    return kept.select("id", "name")


@query
def rules_of_language(spark, sf_dir):
    rules = R.normalise_rules(part_rules(spark, sf_dir))
    return R.rules_for_language(rules, "Java").select("id", "name")


@query
def rules_switched(spark, sf_dir):
    rules = R.set_enabled(R.normalise_rules(part_rules(spark, sf_dir)), ["rule-1", "rule-5", "rule-8"], False)
    return rules.select("id", "name", "enabled")


@query
def rule_by_id(spark, sf_dir):
    return R.rule_by_id(R.normalise_rules(part_rules(spark, sf_dir)), "rule-8").select("id", "name")


@query
def rule_stats(spark, sf_dir):
    return R.rule_stats(R.normalise_rules(part_rules(spark, sf_dir)))


# Quality


@query
def todos(spark, sf_dir):
    return _places(Q.todos(corpus(spark, sf_dir), NOW), "severity", "message", "code_snippet")


@query
def commented_code(spark, sf_dir):
    return _places(Q.commented_code(corpus(spark, sf_dir), NOW), "code_snippet")


@query
def long_lines(spark, sf_dir):
    return _places(Q.long_lines(_documents(spark, sf_dir), now=NOW), "message", "code_snippet")


@query
def complexity(spark, sf_dir):
    return _places(Q.high_complexity(corpus(spark, sf_dir), now=NOW), "message")


@query
def long_functions(spark, sf_dir):
    return _places(Q.long_functions(corpus(spark, sf_dir), now=NOW), "message")


@query
def quality_stats(spark, sf_dir):
    return A.quality_stats(_quality(spark, sf_dir))


# Secrets and duplicates


@query
def secret_places(spark, sf_dir):
    return _places(secrets(_documents(spark, sf_dir), now=NOW), "severity", "code_snippet")


@query
def duplicated_blocks(spark, sf_dir):
    return duplicate_blocks(_documents(spark, sf_dir), k=3).select("file", "line", "copies")


@query
def maximal_blocks(spark, sf_dir):
    """Blocks of three lines or more, on the corpus: the same lines stand in front of very many files."""
    files = corpus(spark, sf_dir).drop("doc_id").unionByName(_documents(spark, sf_dir))
    return B.maximal_blocks(files, k=3).select("file", "line", "lines", "copies")


# Dependencies


def _deps(spark, sf_dir):
    return D.dependencies(D.manifests(manifest_files(spark, sf_dir)))


def _matched(spark, sf_dir, mode="semantic"):
    return D.match_advisories(_deps(spark, sf_dir), builtin_advisories(spark), mode)


@query
def manifests(spark, sf_dir):
    both = manifest_files(spark, sf_dir).unionByName(corpus(spark, sf_dir).select("file", "code"))
    return D.manifests(both).select("file", "base_name")


@query
def requirements_parse(spark, sf_dir):
    return D.requirements_deps(D.manifests(manifest_files(spark, sf_dir)))


@query
def package_json_parse(spark, sf_dir):
    return D.package_json_deps(D.manifests(manifest_files(spark, sf_dir))).drop("operator")


@query
def advisory_join(spark, sf_dir):
    return _matched(spark, sf_dir).select("file", "line", "name", "version", "cve", "severity")


@query
def advisory_join_by_text(spark, sf_dir):
    return _matched(spark, sf_dir, "string").select("file", "line", "name", "version", "cve", "severity")


@query
def many_advisories(spark, sf_dir):
    """An advisory for every part, thousands of them for each of three packages, on all versions in use."""
    advisories = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {a}" for a, e in MANY_ADVISORIES.items()])
    versions = _deps(spark, sf_dir).select("language", "name", "version").distinct()
    found = D.match_advisories(versions, advisories, lists=True)
    # Least and greatest texts are found by sorting: there are as many rows to sort as lists, not as pairs.
    each = found.select("name", "version", F.size("found").alias("n"), F.array_min("found.cve").alias("first"), F.array_max("found.cve").alias("last"))
    every = each.groupBy("name", "version").agg(F.sum("n").alias("advisories"), F.min("first").alias("first_cve"), F.max("last").alias("last_cve"))
    return every.filter("advisories > 0")


@query
def dependency_findings(spark, sf_dir):
    found = D.dependency_findings(_matched(spark, sf_dir), NOW)
    return _places(found, "id", "severity", "cwe", "owasp", "package", "cve", "code_snippet")


@query
def dep_stats(spark, sf_dir):
    return A.dep_stats(D.dependency_findings(_matched(spark, sf_dir), NOW))


@query
def vulnerable_dependencies(spark, sf_dir):
    listed = D.vulnerabilities_of(stored(_deps(spark, sf_dir), "dependencies"), builtin_advisories(spark))
    return D.with_vulnerabilities(listed).select(
        "file", "line", "name", "version", F.array_join("vulnerabilities", ",").alias("cves")
    )


@query
def outdated(spark, sf_dir):
    """Against the newest version of each package in use anywhere."""
    from lintlake.functions.versions import version_key

    deps = stored(_deps(spark, sf_dir), "dependencies")
    latest = deps.groupBy("language", F.col("name").alias("package")).agg(
        F.max_by("version", F.struct(version_key("version"), "version")).alias("latest")
    )
    return D.outdated(deps, latest).select("file", "line", "name", "version", "latest")


# Finding tables


@query
def scanned(spark, sf_dir):
    return _places(_scan(spark, sf_dir), "severity", "finding_type")


@query
def scanned_project(spark, sf_dir):
    """Source files and manifests in one scan, with findings of all four types; texts are read once."""
    path = f"{checkpoint_root(spark)}/project-{uuid.uuid4().hex}"
    write_scan(_project(spark, sf_dir), path, now=NOW, severity="INFO")
    return _places(spark.read.parquet(f"{path}/findings"), "severity", "finding_type")


def _project(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = manifest_files(spark, sf_dir).withColumn("language", F.lit("unknown"))
    return corpus(spark, sf_dir).drop("doc_id").unionByName(manifests)


@query
def observed_metrics(spark, sf_dir):
    """Run metrics that were observed while the findings were written; some files cannot be read, some are too large."""
    key = F.substring_index("file", "/f", -1)
    files = _project(spark, sf_dir).withColumn("code", F.when(~F.endswith(key, F.lit("7.py")), F.col("code")))
    path = f"{checkpoint_root(spark)}/observed-{uuid.uuid4().hex}"
    metrics = write_scan(files, path, now=NOW, severity="INFO", max_mb=0.005)
    errors = spark.read.parquet(f"{path}/errors").agg(*[F.count_if(F.col("error") == e).alias(e) for e in ("unreadable", "too_large")])
    types = ("vulnerability", "secret", "quality", "dependency")
    return metrics.crossJoin(errors).select(
        "total_findings", "risk_score", "files_scanned", "findings_per_file", "errors", "unreadable", "too_large",
        *[F.coalesce(F.col("by_severity")[s], F.lit(0)).alias(s.lower()) for s in SEVERITIES],
        *[F.coalesce(F.col("by_type")[t], F.lit(0)).alias(t) for t in types],
    )


@query
def scanned_unique_files(spark, sf_dir):
    return _places(_scan(spark, sf_dir, unique_files=True), "severity", "finding_type")


@query
def severity_filter(spark, sf_dir):
    return _places(_scan(spark, sf_dir, severity="MEDIUM"), "severity")


@query
def by_severity(spark, sf_dir):
    return _places(N.by_severity(_scan(spark, sf_dir), "high"))


@query
def by_type(spark, sf_dir):
    return _places(N.by_type(_scan(spark, sf_dir), "vulnerability"))


@query
def has_critical(spark, sf_dir):
    return N.has_critical(_scan(spark, sf_dir))


@query
def union_all(spark, sf_dir):
    return _places(N.union_findings(_sast(spark, sf_dir), _quality(spark, sf_dir)), "finding_type")


@query
def dedup(spark, sf_dir):
    return _places(N.dedup(N.union_findings(_sast(spark, sf_dir), _quality(spark, sf_dir))))


@query
def ordered(spark, sf_dir):
    return _places(N.ordered(_scan(spark, sf_dir)), "severity")


@query
def count_by_severity(spark, sf_dir):
    return A.count_by(_scan(spark, sf_dir), "severity")


@query
def count_by_type(spark, sf_dir):
    return A.count_by(_scan(spark, sf_dir), "finding_type")


@query
def risk_score(spark, sf_dir):
    return A.risk_score(_scan(spark, sf_dir), corpus(spark, sf_dir))


@query
def run_metrics(spark, sf_dir):
    metrics = A.run_metrics(_scan(spark, sf_dir), corpus(spark, sf_dir))
    return metrics.select(
        "total_findings", "risk_score", "files_scanned", "findings_per_file", "errors",
        *[F.coalesce(F.col("by_severity")[s], F.lit(0)).alias(s.lower()) for s in SEVERITIES],
        *[F.coalesce(F.col("by_type")[t], F.lit(0)).alias(t) for t in ("vulnerability", "secret", "quality")],
    )


@query
def summary(spark, sf_dir):
    return A.summary(_scan(spark, sf_dir))


@query
def vuln_stats(spark, sf_dir):
    return A.vuln_stats(_sast(spark, sf_dir))


@query
def merged_vuln_stats(spark, sf_dir):
    """Statistics of two runs, stored apart and merged."""
    files = corpus(spark, sf_dir)
    runs = [files.filter(F.col("doc_id") % 3 == 0), files.filter(F.col("doc_id") % 3 != 0)]
    states = [stored(A.stats_state(sast_findings(run, None, NOW), "vulnerability"), "stats") for run in runs]
    return A.stats_of(A.merge_stats(*states), "vulnerability")


# Sinks


@query
def sarif_results(spark, sf_dir):
    return sinks.sarif_results(_scan(spark, sf_dir)).drop("message")


@query
def sarif_rules(spark, sf_dir):
    return sinks.sarif_rules(_scan(spark, sf_dir)).select("rule_id", "at.file", "at.line")


@query
def text_lines(spark, sf_dir):
    return sinks.to_text(_scan(spark, sf_dir)).select("short_text")


@query
def written_report(spark, sf_dir):
    """Findings written as JSON and read back."""
    path = f"{checkpoint_root(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_findings(_scan(spark, sf_dir), path, "json")
    back = spark.read.schema("id string, rule_id string, severity string, file string, line int, message string, "
                             "code string").json(path)  # fmt: skip
    return back.select("rule_id", "severity", "file", "line")


@query
def csv_report(spark, sf_dir):
    """Findings written as CSV and read back."""
    path = f"{checkpoint_root(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_findings(_scan(spark, sf_dir), path, "csv")
    back = spark.read.option("escape", '"').option("multiLine", True).csv(path, header=True)
    return back.select("rule_id", "severity", "finding_type", "file", F.col("line").cast("int"))


@query
def sarif_document(spark, sf_dir):
    """The results of a SARIF log written from a scan and read back."""
    path = f"{checkpoint_root(spark)}/sarif-{uuid.uuid4().hex}"
    sinks.write_sarif(_scan(spark, sf_dir), path)
    place = "locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, startColumn: int>>>>"
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("value")).filter("value LIKE '{\"ruleId%'")
    result = lines.select(F.from_json("value", f"ruleId string, level string, {place}").alias("r"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return result.select(
        F.col("r.ruleId").alias("rule_id"), "r.level", at["artifactLocation"]["uri"].alias("uri"),
        at["region"]["startLine"].alias("start_line"), at["region"]["startColumn"].alias("start_column"),
    )


# Over time


def _sightings(findings: DataFrame) -> DataFrame:
    return findings.drop("seq")


@query
def lifecycle(spark, sf_dir):
    """Long lines under a looser limit before, under a stricter one and secrets now."""
    docs = _documents(spark, sf_dir)
    states = F.expr("element_at(array('open', 'ignored', 'false_positive', 'in_progress'), CAST(line % 4 AS INT) + 1)")
    previous = _sightings(Q.long_lines(docs, 120, BEFORE)).withColumn("status", states)
    current = _sightings(N.union_findings(Q.long_lines(docs, 400, NOW), N.dedup(secrets(docs, now=NOW))))
    merged = merge_lifecycle(previous, current, NOW)
    return _history(merged)


@query
def lifecycle_in_scope(spark, sf_dir):
    """A run over the English documents: what is known of the others stays as it was."""
    docs = _documents(spark, sf_dir)
    states = F.expr("element_at(array('open', 'ignored', 'false_positive', 'in_progress'), CAST(line % 4 AS INT) + 1)")
    previous = _sightings(Q.long_lines(docs, 120, BEFORE)).withColumn("status", states)
    english = table(spark, sf_dir, "documents").filter("lang = 'en'")
    scope = english.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"))
    current = _sightings(Q.long_lines(docs.join(scope, "file", "left_semi"), 400, NOW))
    return _history(merge_lifecycle(previous, current, NOW, scope))


def _history(merged: DataFrame) -> DataFrame:
    return merged.select(
        "file", "line", "rule_id", "status",
        F.date_format("first_seen", "yyyy").alias("first_year"), F.date_format("last_seen", "yyyy").alias("last_year"),
    )


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The corpus in three batches: files that are new, rewritten, as they were, and removed."""
    files = corpus(spark, sf_dir).withColumn("removed", F.lit(False))
    first, second = F.col("doc_id") % 3 != 2, F.col("doc_id") % 5 == 1
    third, gone = F.col("doc_id") % 5 == 2, F.col("doc_id") % 4 == 3
    above, below = F.concat(F.lit("x = eval(y)\n"), "code"), F.concat("code", F.lit("\nz = eval(w)"))
    again = files.filter(first & ~second & (F.col("doc_id") % 7 == 0))
    return [
        files.filter(first),
        files.filter(~first).union(files.filter(first & second).withColumn("code", above)).union(again),
        files.filter(third & ~gone).withColumn("code", below).union(files.filter(gone).withColumns({"removed": F.lit(True), "code": F.lit(None)})),
    ]


@query
def tracked_files(spark, sf_dir):
    """The history of all findings after three batches of a stream."""
    root = f"{checkpoint_root(spark)}/tracked-{uuid.uuid4().hex}"
    tracker = Tracker(spark, f"{root}/tables", buckets=16, severity="INFO", now=NOW)
    for n, batch in enumerate(_arrivals(spark, sf_dir)):
        batch.drop("doc_id").write.parquet(f"{root}/arrivals/batch={n}")
        arrived = spark.readStream.schema("file string, language string, code string, removed boolean")
        tracker.run_available(arrived.parquet(f"{root}/arrivals/batch=*"), f"{root}/checkpoint")
    return _places(tracker.findings(), "status", "severity")


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A table is a file or a folder of files.  As a pattern the name stands for either: a stream takes a plain path for a folder.
    schema = table(spark, sf_dir, "documents").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    return raw.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"),
        F.col("text").alias("code"),
        F.lit("python").alias("language"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    path = f"{checkpoint_root(spark)}/findings-{uuid.uuid4().hex}"
    run_available(scan_stream(_document_stream(spark, sf_dir), severity="INFO", now=NOW), path)
    return path


@query
def incremental(spark, sf_dir):
    """The documents scanned as a stream."""
    found = spark.read.parquet(_streamed(spark, sf_dir))
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))


@query
def streamed_sightings(spark, sf_dir):
    """First and last sightings kept by a second stream over the streamed findings."""
    path = _streamed(spark, sf_dir)
    out = f"{checkpoint_root(spark)}/sightings-{uuid.uuid4().hex}"
    findings = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    writer = (
        lifecycle_stream(findings)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{checkpoint_root(spark)}/state-{uuid.uuid4().hex}")
        .foreachBatch(lambda batch, n: batch.write.mode("append").parquet(out))
        .trigger(availableNow=True)
        .start()
    )
    writer.awaitTermination()
    seen = spark.read.parquet(out)
    merged = merge_sightings(seen, seen)
    return merged.select("id", (F.col("first_seen") == F.col("last_seen")).alias("once"))
