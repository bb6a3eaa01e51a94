"""Manifests, dependencies and advisories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.builtin.tables import (
    DEPENDENCY_CWE,
    DEPENDENCY_OWASP,
    MANIFEST_NAMES,
    MANIFEST_SUFFIX,
)
from lintlake.functions.identity import finding_id_sql
from lintlake.functions.patterns import SPACE
from lintlake.functions.severity import rank_sql
from lintlake.functions.sqltext import chain, let, quote
from lintlake.functions.versions import comparable_sql, range_sql, version_lt
from lintlake.operators.hits import DEPENDENCY, hit_sql, timestamp
from lintlake.support import explode_once

# Fixed value: a pinned requirement is name, operator, version.
REQUIREMENT = rf"^([a-zA-Z0-9\-_]+){SPACE}*([=><~!]+){SPACE}*([0-9.]+)"


def base_name(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def is_manifest(file: Column) -> Column:
    return base_name(file).isin(MANIFEST_NAMES) | F.endswith(file, F.lit(MANIFEST_SUFFIX))


def manifests(files: DataFrame, root: str | None = None) -> DataFrame:
    """(file, base_name, text) of the dependency manifests among `files`.

    With a `root`, plain names count only directly under it, and project files
    (`*.csproj`) at any depth; without, every folder may be a project.
    """
    name = base_name(F.col("file"))
    plain = name.isin(MANIFEST_NAMES)
    if root is not None:
        plain = plain & (F.col("file") == F.concat(F.lit(root.rstrip("/") + "/"), name))
    return files.filter(plain | F.endswith("file", F.lit(MANIFEST_SUFFIX))).select(
        "file", name.alias("base_name"), F.col("code").alias("text")
    )


_ENTRIES = "ARRAY<STRUCT<name: STRING, version: STRING, operator: STRING, line: INT>>"
_NO_ENTRIES = f"CAST(array() AS {_ENTRIES})"
_NAME = "lower(base_name)"
_IS_REQUIREMENTS = f"(contains({_NAME}, 'requirements') OR {_NAME} = 'pipfile')"
_IS_PACKAGE_JSON = f"{_NAME} = 'package.json'"


def _requirements_sql(text: str) -> str:
    """Pinned requirements, one per line.  The operator is kept but not used."""
    regex = quote(f"(?U)^{SPACE}*" + REQUIREMENT.removeprefix("^"))
    part = lambda group: f"regexp_extract(raw, {regex}, {group})"
    entry = (
        f"named_struct('name', lower({part(1)}), 'version', {part(3)}, 'operator', {part(2)}, "
        "'line', CAST(i + 1 AS INT))"
    )
    lines = f"transform(split({text}, chr(10), -1), (raw, i) -> IF(raw RLIKE {regex}, {entry}, NULL))"
    return f"filter({lines}, d -> d IS NOT NULL)"


def _package_json_sql(text: str) -> str:
    """Entries of `dependencies` and `devDependencies`; of one name the last wins."""
    members = ("dependencies", "devDependencies")
    schema = ", ".join(f"{m} MAP<STRING, STRING>" for m in members)
    lists = ", ".join(f"coalesce(map_entries(doc.{m}), array())" for m in members)
    numbered = f"transform(concat({lists}), (e, i) -> named_struct('name', e.key, 'at', i, 'version', e.value))"
    # Sorted, the entries of one name are neighbours and the last of them counts.
    last = "e.version IS NOT NULL AND (get(es, i + 1) IS NULL OR get(es, i + 1).name != e.name)"
    kept = let(f"sort_array({numbered})", "es", f"filter(es, (e, i) -> {last})")
    entry = (
        "named_struct('name', e.name, 'version', translate(e.version, '^~><=', ''), "
        "'operator', CAST(NULL AS STRING), 'line', 1)"
    )
    return let(f"from_json({text}, '{schema}')", "doc", f"transform({kept}, e -> {entry})")


def _exploded(manifest_table: DataFrame, cases: list[tuple[str, str]], language: str) -> DataFrame:
    entries = F.expr(chain(cases, _NO_ENTRIES))
    named = manifest_table.withColumn("language", F.expr(language))
    return explode_once(named, entries, "d", "file", "language").select(
        "file", "d.name", "d.version", "language", "d.operator", "d.line"
    )


def requirements_deps(manifest_table: DataFrame) -> DataFrame:
    """Dependencies of requirements files and Pipfiles."""
    return _exploded(manifest_table, [(_IS_REQUIREMENTS, _requirements_sql("text"))], "'python'")


def package_json_deps(manifest_table: DataFrame) -> DataFrame:
    """Dependencies of package.json files."""
    return _exploded(manifest_table, [(_IS_PACKAGE_JSON, _package_json_sql("text"))], "'javascript'")


def dependencies(manifest_table: DataFrame) -> DataFrame:
    """Dependencies of all manifests, each read once."""
    cases = [(_IS_REQUIREMENTS, _requirements_sql("text")), (_IS_PACKAGE_JSON, _package_json_sql("text"))]
    return _exploded(manifest_table, cases, f"IF({_IS_PACKAGE_JSON}, 'javascript', 'python')")


# Advisories of a package that are looked through as one.
_BLOCK_BITS = 8


def _upper_bounds(known: DataFrame) -> DataFrame:
    """Ranges without a lower end, per package in blocks of ascending bounds: (language, _package, entries, most)."""
    order = Window.partitionBy("language", "_package").orderBy("range.key", "range.inclusive")
    block = F.shiftright(F.row_number().over(order) - 1, _BLOCK_BITS)
    entry = F.struct("range.key", "range.inclusive", "version_spec", "cve", "severity")
    return (
        known.filter("range.below")
        .withColumn("_block", block)
        .groupBy("language", "_package", "_block")
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.max("range.key").alias("most"))
        .drop("_block")
    )


def _covering_sql(have: str, entries: str) -> str:
    """The entries that cover a version: the last ones from a place on, which is found by bisection."""
    covers = f"e.key > {have} OR (e.key = {have} AND e.inclusive)"
    middle = "CAST((s.low + s.high) DIV 2 AS INT)"
    lower, upper = "named_struct('low', s.low, 'high', mid)", "named_struct('low', mid + 1, 'high', s.high)"
    step = let(middle, "mid", let(f"get({entries}, mid)", "e", f"IF({covers}, {lower}, {upper})"))
    start = f"named_struct('low', 0, 'high', size({entries}))"
    place = f"aggregate(sequence(0, {_BLOCK_BITS}), {start}, (s, i) -> IF(s.low < s.high, {step}, s), s -> s.low)"
    return let(place, "low", f"slice({entries}, low + 1, size({entries}))")


# What parts the fields in the id of a dependency among the hits.
_PART = "chr(0)"


def entry_hits_sql(code: str) -> str:
    """The dependencies of a manifest as hits, beside those of other detectors; the file's `base_name` is at hand."""
    cases = [(_IS_REQUIREMENTS, _requirements_sql(code)), (_IS_PACKAGE_JSON, _package_json_sql(code))]
    language = f"IF({_IS_PACKAGE_JSON}, 'javascript', 'python')"
    name = f"concat_ws({_PART}, {language}, d.name, d.version)"
    return f"transform({chain(cases, _NO_ENTRIES)}, (d, i) -> {hit_sql('d.line', name, DEPENDENCY, 'i', text=name)})"


# True of every hit, and on all that findings are made of, but nothing on what hits are made unique by: parts of a plan
# with this filter need the same rows and columns of the hits, however little is wanted of them in the end, and Spark
# makes those once for all.
WHOLE_HIT = "coalesce(snippet, text, string(amount), string(limit), string(column), string(seq)) IS NOT NULL"


def entries_of(hits: DataFrame) -> DataFrame:
    """The dependencies among the hits of a scan."""
    parts = F.split("text", "\\x00", -1)
    return hits.filter(F.col("analyzer") == DEPENDENCY).filter(WHOLE_HIT).select(
        "file", F.get(parts, F.lit(1)).alias("name"), F.get(parts, F.lit(2)).alias("version"), F.get(parts, F.lit(0)).alias("language"),
        F.lit(None).cast("string").alias("operator"), "line",
    )


def match_advisories(deps: DataFrame, advisories: DataFrame, mode: str = "semantic", lists: bool = False) -> DataFrame:
    """Every (dependency, advisory) pair whose range covers the version.

    With `lists` the advisories of a dependency stay in lists `found`, as they come out of the blocks, some of
    them empty: what is worked out of them then needs no row for every pair.

    Advisories of one version are joined by it.  Ranges come in blocks of ascending bounds, hundreds to a row: a block
    that ends below the version is no row, and in the others bisection finds the ranges that cover it.  So a package
    with very many advisories makes no rows but those that match.  Spark chooses the joins by the size of the advisory
    table: broadcast when small, otherwise sort-merge with run-time splitting of hot packages.
    """
    if mode not in ("semantic", "string"):
        raise ValueError(f"unknown version mode: {mode}")
    known = advisories.select(
        "language", F.lower("package").alias("_package"), "version_spec", "cve", "severity",
        F.expr(range_sql("version_spec", mode)).alias("range"),
    ).filter("range.key IS NOT NULL")
    keyed = deps.withColumns({"_package": F.lower("name"), "_have": F.expr(comparable_sql("version", mode))})
    # One pass over the dependencies: a row for each block and, in a block of their own, for the advisories of its version.
    exact = known.filter("NOT range.below").groupBy("language", "_package", F.col("range.key").alias("most")).agg(
        F.collect_list(F.struct("range.key", F.lit(True).alias("inclusive"), "version_spec", "cve", "severity")).alias("entries")
    )
    blocks = _upper_bounds(known).withColumn("_only", F.lit(False)).unionByName(exact.withColumn("_only", F.lit(True)))
    reaches = F.when(F.col("_only"), F.col("most") == F.col("_have")).otherwise(F.col("most") >= F.col("_have"))
    joined = keyed.join(blocks, ["language", "_package"]).filter(reaches)
    covering = F.expr(f"IF(_only, entries, {_covering_sql('_have', 'entries')})")
    names = [F.col(c) for c in deps.columns]
    if lists:
        return joined.select(*names, covering.alias("found"))
    found = joined.select(*names, F.explode(covering).alias("_found"))
    return found.select(*names, "_found.version_spec", "_found.cve", "_found.severity")


def dependency_findings(matched: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """Findings for matched dependencies."""
    seed = "concat('dep_', cve)"
    return matched.withColumn("_now", timestamp(now)).selectExpr(
        f"{finding_id_sql('file', 'line', seed)} AS id",
        "concat('dependency_', cve) AS rule_id",
        "'dependency' AS finding_type",
        "severity",
        f"{rank_sql('severity')} AS severity_rank",
        "file",
        "line",
        "1 AS column",
        "concat_ws(' ', 'Vulnerable dependency:', name, version) AS message",
        "concat(name, '==', version) AS code_snippet",
        f"'{DEPENDENCY_CWE}' AS cwe",
        "CAST(NULL AS DOUBLE) AS cvss",
        "CAST(NULL AS STRING) AS cvss_vector",
        f"'{DEPENDENCY_OWASP}' AS owasp",
        "CAST(NULL AS STRING) AS category",
        "name AS package",
        "cve",
        """array(concat('Raise the pin of ', name, ' above the affected range; where that is impossible, '
            'find out from the advisory whether the vulnerable part is used')) AS remediations""",
        # The two address prefixes.
        """array(concat('https://cve.mitre.org/cgi-bin/cvename.cgi?name=', cve),
            concat('https://nvd.nist.gov/vuln/detail/', cve)) AS references""",
        "'open' AS status",
        "_now AS first_seen",
        "_now AS last_seen",
        "map('package', name, 'current_version', version, 'cve', cve, 'language', language) AS context",
        "0L AS seq",
    )


def with_vulnerabilities(deps: DataFrame) -> DataFrame:
    """Dependencies whose `vulnerabilities` list is not empty."""
    return deps.filter(F.size("vulnerabilities") > 0)


def vulnerabilities_of(deps: DataFrame, advisories: DataFrame, mode: str = "semantic") -> DataFrame:
    """Every dependency with the list of the CVEs that cover it.

    The list is made per distinct (language, package, version) first: a popular
    version is looked up once, however many manifests name it.
    """
    package = F.lower("name").alias("_package")
    versions = deps.select("language", package, "version").distinct().withColumnRenamed("_package", "name")
    lists = (
        match_advisories(versions, advisories, mode)
        .groupBy("language", F.col("name").alias("_package"), "version")
        .agg(F.sort_array(F.collect_set("cve")).alias("vulnerabilities"))
    )
    none = F.array().cast("array<string>")
    return (
        deps.withColumn("_package", F.lower("name"))
        .join(lists, ["language", "_package", "version"], "left")
        .withColumn("vulnerabilities", F.coalesce("vulnerabilities", none))
        .drop("_package")
    )


def outdated(deps: DataFrame, latest: DataFrame) -> DataFrame:
    """Dependencies older than the `latest` version of their package."""
    newest = latest.select("language", F.lower("package").alias("_package"), "latest")
    return (
        deps.withColumn("_package", F.lower("name"))
        .join(newest, ["language", "_package"])
        .filter(version_lt("version", "latest"))
        .drop("_package")
    )
